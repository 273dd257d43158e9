import random
from collections import defaultdict

import pytest

from phonolith.llm import line_dedup as D
from phonolith.llm.common import mark

ODD = "doc_id long, text string, lines string"


def run(spark, rows, tree=D.Tree()):
    docs = spark.createDataFrame(rows, ODD)
    return docs, D.line_dedup(docs, tree).collect()


def own(rng, n=6):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_recurring_lines_go_but_once(spark):
    foot = "All rights reserved by us."
    rows = [(i, f"{chr(97 + i) * 3} here are its own words\n{foot}\nlast own words {chr(97 + i) * 4}", "x") for i in range(6)]
    rows += [(50, None, "x"), (51, "", "x"), (52, "\n\n", "x"), (53, foot, "x"), (53, foot, "x"), (None, f"a {foot}\n{foot}", "x")]
    docs, got = run(spark, rows)
    texts = sorted((str(r["doc_id"]), r["text"], r[mark("n_lines")], r[mark("n_dropped")]) for r in got)
    want = [("0", rows[0][1], 3, 0)] + [(str(i), rows[i][1].replace(f"{foot}\n", ""), 3, 1) for i in range(1, 6)]
    want += [("50", None, 0, 0), ("51", "", 1, 0), ("52", "\n\n", 3, 0), ("53", "", 1, 1), ("53", "", 1, 1), ("None", f"a {foot}", 2, 1)]
    assert texts == sorted(want, key=lambda r: (r[0], str(r[1])))
    assert D.line_dedup(docs).columns == [*docs.columns, mark("n_lines"), mark("n_dropped")]
    assert D.line_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        D.line_dedup(docs.withColumnRenamed("lines", mark("lines")))


def test_every_line_of_a_footer_goes_and_short_ones_too(spark):
    rng = random.Random(1)
    foot = "Home\nContact the editors of this page\nReleased under the MIT License."
    rows = [(i, f"{own(rng)}\n{own(rng)}\n{foot}", "x") for i in range(200)]
    _, got = run(spark, rows)
    assert {r["doc_id"]: r[mark("n_dropped")] for r in got} == {i: 3 * (i > 0) for i in range(200)}
    assert all(r["text"] == "\n".join(rows[r["doc_id"]][1].split("\n")[:2]) for r in got if r["doc_id"])


def test_lines_count_by_different_texts(spark):
    rng = random.Random(2)
    twice, thrice = own(rng), own(rng)
    rows = [(1, f"{own(rng)}\n{twice}", "x"), (2, "\n".join(f"{own(rng)}\n{twice}" for _ in range(9)), "x")]
    copy = f"{own(rng)}\n{thrice}\n{own(rng)}"
    rows += [(10 + i, copy, "x") for i in range(30)] + [(50, f"{thrice}\n{own(rng)}", "x")]
    _, got = run(spark, rows)
    assert all(r[mark("n_dropped")] == 0 for r in got)
    _, got = run(spark, [*rows, (5, f"{own(rng)}\n{thrice}", "x"), (60, copy, "x"), (2, copy, "x")])
    # Document 2 now has the copied text and the smallest id, so all copies of it keep the line.
    assert sorted(r["doc_id"] for r in got if r[mark("n_dropped")]) == [5, 50]


def test_variable_fields_are_generalised(spark):
    names = ["ann", "bob", "cyd", "dee", "eve", "flo"]
    rows = [(i, f"start {n}\nthe user called {n} logged out after {i * 7} seconds\nend {n}", "x") for i, n in enumerate(names)]
    _, got = run(spark, rows)
    assert sorted(r[mark("n_dropped")] for r in got) == [0, 1, 1, 1, 1, 1]


def test_two_equally_common_templates_of_one_leaf(spark):
    names = [own(random.Random(i), 1) for i in range(8)]
    first = [(i, f"{n} begins\nthe user called {n} logged out of the system", "x") for i, n in enumerate(names)]
    second = [(20 + i, f"{n} ends\nthe user called {n} was refused an entry today", "x") for i, n in enumerate(names)]
    third = [(40 + i, f"{n} again\nthe user called {n} {n}a {n}b {n}c {n}d {n}e", "x") for i, n in enumerate(names)]
    assert len({len(r[1].split("\n")[1].split()) for r in [*first, *second, *third]}) == 1
    _, got = run(spark, [*first, *second, *third])
    assert {r["doc_id"] for r in got if r[mark("n_dropped")]} == {*range(1, 8), *range(21, 28)}


def test_short_clean_lines_and_rows_of_numbers_stay(spark):
    ends = [f"{chr(97 + i)}{chr(110 + i)}" for i in range(12)]
    lines = [f"it was the {e}" for e in ends] + [f"it was the {e} {e}x" for e in ends] + [f"it was the {e} day" for e in ends]
    lines += [f"{i} {i + 1} total {i * 3}" for i in range(9)]
    rng = random.Random(3)
    rows = [(i, f"{own(rng)}\n{line}\n{own(rng)}", "x") for i, line in enumerate(lines)]
    rows += [(100 + i, "the same beginning " + " ".join(f"{chr(97 + i)}{chr(97 + j)}" for j in range(9)), "x") for i in range(20)]
    _, got = run(spark, rows)
    assert all(r[mark("n_dropped")] == 0 for r in got)


def test_a_very_long_text_with_many_dropped_lines(spark):
    foot = "this line is everywhere"
    rows = [(i, f"{chr(97 + i)} own words\n{foot}\n{chr(98 + i)} own", "x") for i in range(5)]
    rows.append((9, "\n".join(f"kept {i}{i}k x{i}\n{foot}" for i in range(20_000)), "x"))
    _, got = run(spark, rows)
    long = next(r for r in got if r["doc_id"] == 9)
    assert long[mark("n_dropped")] == 20_000 and long["text"] == "\n".join(f"kept {i}{i}k x{i}" for i in range(20_000))


def test_recall_and_clean_lines_against_all_pairs(spark):
    """Against comparing every line with every other: what has a similar line in 3 texts goes, but for one text."""
    rng = random.Random(7)
    frames = [own(rng, n).split() for n in (1, 2, 4, 6, 9, 14) for _ in range(4)]
    holes = [set(rng.sample(range(3, len(f)), len(f) // 5)) if len(f) > 5 else set() for f in frames]
    texts = {}
    for i in range(120):
        lines = [own(rng, rng.randint(3, 12)) for _ in range(5)]
        for k in rng.sample(range(len(frames)), 3):
            lines.insert(rng.randint(0, len(lines)), " ".join(own(rng, 1) if at in holes[k] else w for at, w in enumerate(frames[k])))
        texts[i] = "\n".join(lines)
    _, got = run(spark, [(i, t, "x") for i, t in texts.items()])
    lines = [(i, at, line.split()) for i, t in texts.items() for at, line in enumerate(t.split("\n"))]
    where = defaultdict(set)
    for i, at, a in lines:
        for j, _, b in lines:
            if len(a) == len(b) and a[:3] == b[:3] and sum(x == y for x, y in zip(a[3:], b[3:])) >= 0.6 * (len(a) - 3):
                where[i, at].add(j)
    want = {key for key, found in where.items() if len(found) >= 3 and key[0] != min(found)}
    gone = set()
    for r in got:
        left = r["text"].split("\n") if r["text"] else []
        for at, line in enumerate(texts[r["doc_id"]].split("\n")):
            if left[:1] == [line]:
                left = left[1:]
            else:
                gone.add((r["doc_id"], at))
    assert len(want) > 250 and len(want & gone) >= 0.98 * len(want) and not gone - want
