import re

import pytest

from phonolith.llm import decontaminate as D
from phonolith.llm.common import LOWER, UPPER

PASSAGE = "one two Three four, five six seven eight nine ten eleven"


def brute(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(UPPER, LOWER)))
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        k = min(n, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1 if k else 0):
            if tuple(own[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast", [True, False])
def test_reports_match_brute_force_and_filters_keep_clean_rows(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(D, "MAX_BROADCAST_WINDOWS", 0)
    items = [(1, PASSAGE), (2, "tiny item"), (3, None), (4, "..."), (12, PASSAGE.upper())]
    texts = [None, "", "!!", PASSAGE, f"é {PASSAGE} {PASSAGE} x", "a TINY-item b", "one two three four five six seven eight nine", "word " * 20000, PASSAGE]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(8, PASSAGE, 1), (None, "tiny item", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in D.report(docs, bench).collect())
    assert got == sorted((str(i), *(b := brute(t, items)), b[1] > 0) for i, t, _ in rows)
    clean = D.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [0, 1, 2, 6, 7]
    assert D.report(docs.limit(0), bench).count() == 0 and D.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_spans_are_cut_out_of_the_text(spark):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "tiny item")], "item_id long, text string")
    cases = [
        (None, None),
        ("", ""),
        ("Nothing, to (cut).", "Nothing, to (cut)."),
        (f"(Before) {PASSAGE}! After.", "(Before) After."),
        (f"  {PASSAGE.upper()}", "  "),
        ("tiny item; É TINY\nitem x", "É x"),
        ("tiny item, " * 5_000 + "end", "end"),
        ("own words " * 5_000, "own words " * 5_000),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases)] + [(5, cases[5][0], "x")], "doc_id long, text string, items string")
    got = D.remove_spans(docs, bench)
    assert got.columns == docs.columns
    rows = sorted(got.collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows] == [cases[r["doc_id"]][1] for r in rows] and len(rows) == len(cases) + 1
    assert D.remove_spans(docs.limit(0), bench).count() == 0
