"""The pipeline against a brute-force version on a small table with planted cases."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from phonolith.llm import quality
from phonolith.llm.common import mark


def words(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ru", "te", "so"]) for _ in range(3)) for _ in range(n))


def table(rng):
    passage = words(rng, 14)
    foot = "all rights reserved by the owner"
    rows = [(i, f"{words(rng, 30)}\n{foot}\n{words(rng, 30)}") for i in range(15)]
    rows += [(20, "too short"), (21, "again and again " * 30), (22, None), (23, "")]
    rows += [(30, copy := words(rng, 60)), (31, copy), (32, copy)]
    rows += [(40, f"{words(rng, 30)} {passage} {words(rng, 30)}")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], passage, foot


def test_each_stage_and_the_result(spark, tmp_path):
    rows, passage, foot = table(random.Random(11))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), schema)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    # Brute force: the base rules, the footer of all but the first document, one of each copy, the leak.
    good = {i: t for i, t, *_ in rows if t and len(t.split()) >= 20 and i != 21}
    assert kept[0] == good
    lines = {i: t if i == 0 else t.replace(f"{foot}\n", "") for i, t in good.items()}
    assert kept[1] == lines and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    single = {i: t for i, t in lines.items() if i not in (31, 32)}
    assert kept[2] == single
    clean = {i: t for i, t in single.items() if i != 40}
    assert kept[3] == clean
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(clean)
    room = Counter()
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 1024 and quality.Rules().min_words == 20


WIDE = "doc_id long, text string, lang string, source string, n_chars long, lines string, items int, fp long"


def rare(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def staged(spark, rows, tmp_path, schema=WIDE):
    """The ids and texts that each stage but the last keeps, and the packed pieces' ids."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "ten words that no other text of this table has at all"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(Counter((r["doc_id"], r["text"]) for r in docs.collect()))
        assert all((r["lines"], r["items"], r["fp"]) == ("x", 7, None) for r in docs.collect())
    return kept, Counter({r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()})


def test_null_ids_repeated_rows_very_long_texts_and_further_columns(spark, tmp_path):
    rng = random.Random(4)
    copy, long = rare(rng, 50), "\n".join(rare(rng, 20) for _ in range(4000))
    texts = [(None, rare(rng, 40)), (None, None), (1, copy), (1, copy), (None, copy), (2, copy + " end"), (3, long), (4, long.replace(long[:7], "edited")), (5, rare(rng, 30)), (5, rare(rng, 31))]
    rows = [(i, t, None, "s", len(t or ""), "x", 7, None) for i, t in texts]
    kept, packed = staged(spark, rows, tmp_path)
    good = Counter((i, t) for i, t in texts if t)
    assert kept[0] == good
    # Of each group of near copies the smallest id stays, once; the long text's lines are those of its edited copy, two texts, and stay.
    want = Counter({texts[0]: 1, (1, copy): 1, (3, long): 1, texts[8]: 1, texts[9]: 1})
    assert kept[1] == good and kept[2] == want and kept[3] == want
    assert packed == Counter({None: 1, 1: 1, 3: 1, 5: 1})


def test_empty_tables(spark, tmp_path):
    kept, packed = staged(spark, [], tmp_path)
    assert kept == [Counter()] * 4 and not packed


def test_columns_with_the_operators_suffix_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 2)], f"doc_id long, text string, {mark('kept')} int")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        with pytest.raises(ValueError, match="reserved"):
            stage(spark, docs, str(tmp_path))
