"""The search index against the scan of the texts."""

import os
import random
import re
from dataclasses import replace

import pytest
from phonolith.operators import search, text_index
from phonolith.plans.adapters import catalog
from phonolith.schema import SearchQuery, SortDirection
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    found = catalog(spark, SF)
    rng = random.Random(1)
    odd = ["the-the-thethe", "x", "", None, "tab\there\nand\x0bthere", "NON BREAK", "the " * 3000, "under_score% the", "ÀÉ the ß", "((the))"]
    rows = [(10_000 + i, rng.choice(odd), rng.choice(odd)) for i in range(40)] + [(70_000 + i, "the far one", None) for i in range(3)]
    more = found.assets.limit(1).drop("id", "notes", "publisher").crossJoin(spark.createDataFrame(rows, "id long, notes string, publisher string"))
    assets = found.assets.unionByName(more.select(*found.assets.columns))
    return replace(found, assets=spark.createDataFrame(assets.collect(), assets.schema))


@pytest.fixture(scope="module")
def index(whole, tmp_path_factory):
    return text_index.built(whole.assets, f"file://{tmp_path_factory.mktemp('index')}", buckets=5, block=32)


def same(got, wanted):
    a, b = got.collect(), wanted.collect()
    assert [r["id"] for r in a] == [r["id"] for r in b]
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b], rel=1e-9)


@pytest.mark.parametrize("text", ["the", "the ing", "e-t", "src1 the tion", "the((the", "nowherexyz", "the nowherexyz", "score%", "break", "ß the"])
def test_pages_and_totals_are_those_of_a_scan(whole, index, text):
    for q in (SearchQuery(text), SearchQuery(text, sort_dir=SortDirection.ASC, offset=3, limit=7, channels=2)):
        got, wanted = text_index.indexed_search(index, whole, q), search.search(whole, q)
        same(got.page, wanted.page)
        assert got.total.first() == wanted.total.first()


def test_short_and_blank_searches_fall_back(whole, index):
    for q in (SearchQuery(""), SearchQuery("th"), SearchQuery("a b")):
        assert [r["id"] for r in text_index.indexed_search(index, whole, q).page.collect()] == [r["id"] for r in search.search(whole, q).page.collect()]


@pytest.mark.parametrize("text", ["the", "the ing", "far", "nowherexyz"])
@pytest.mark.parametrize("best", [True, False])
def test_top_pages_read_few_blocks(whole, index, text, best):
    q = SearchQuery(text, offset=1, limit=4)
    got = text_index.top_hits(index, whole, q, best_first=best, first_blocks=1)
    same(got.page, search.search(whole, q, best_first=best).page)
    # The bounds of several tokens add up, so on these few blocks they exclude none.
    assert got.read <= got.blocks and (text != "the" or not best or got.read < got.blocks)


def test_no_text_is_scanned(whole, index, spark, tmp_path):
    whole.assets.write.parquet(f"{tmp_path}/assets")
    stored = replace(whole, assets=spark.read.parquet(f"{tmp_path}/assets"))
    page = text_index.indexed_search(index, stored, SearchQuery("the ing")).page
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "notes" not in plan and "filename" in plan
    notes = {r["id"]: r["notes"] for r in text_index.with_notes(page, stored.assets).collect()}
    assert notes == {r["id"]: r["notes"] for r in search.search(whole, SearchQuery("the ing")).page.collect()}
    # Only the folders of the trigrams' buckets are listed.
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text_index._under(index, ["the"])._jdf.queryExecution().toString())


def test_inserts_updates_and_deletes(whole, spark, tmp_path):
    first = whole.assets.where("id % 4 <> 1")
    index = text_index.built(first, f"file://{tmp_path}", buckets=3, block=32)
    came = whole.assets.where("id % 4 = 1")
    edited = first.where("id % 3 = 0").withColumn("notes", F.concat(F.lit("thething "), F.coalesce("notes", F.lit(""))))
    gone = first.where("id % 5 = 0").select("id")
    after = text_index.changed(index, came.unionByName(edited.join(gone, "id", "left_anti")), gone)
    now = first.where("id % 3 <> 0").unionByName(edited).join(gone, "id", "left_anti").unionByName(came)
    new = replace(whole, assets=spark.createDataFrame(now.select(*whole.assets.columns).collect(), whole.assets.schema))
    for text in ("the", "thething", "the ing"):
        q = SearchQuery(text)
        same(text_index.indexed_search(after, new, q).page, search.search(new, q).page)
        same(text_index.top_hits(after, new, q, first_blocks=1).page, search.search(new, q, best_first=True).page)
    # The index before the change still answers for the catalog before it.
    same(text_index.indexed_search(index, replace(whole, assets=first), SearchQuery("the")).page, search.search(replace(whole, assets=first), SearchQuery("the")).page)
    # A failed attempt's rows are never live.
    text_index._append(came, after.folder, after.buckets, after.block, "failed")
    again = text_index._read(spark, after.folder, os.path.basename(after.live.inputFiles()[0].rsplit("/", 1)[0]), after.buckets, after.block, False)
    same(text_index.indexed_search(again, new, SearchQuery("the")).page, search.search(new, SearchQuery("the")).page)


def test_no_assets(whole, tmp_path):
    none = replace(whole, assets=whole.assets.where("id < 0"))
    index = text_index.built(none.assets, f"file://{tmp_path}")
    assert text_index.indexed_search(index, none, SearchQuery("the")).page.collect() == []
    assert text_index.top_hits(index, none, SearchQuery("the")).page.collect() == []


def test_packed_postings_are_the_words_of_each_asset(whole, monkeypatch):
    """Also where a task cuts its texts into slices, within blocks."""
    monkeypatch.setattr(text_index, "SLICE_BYTES", 2000)
    found = {}
    for r in text_index.packed_postings(whole.assets, 32).select("word", "block", *text_index.unpacked()).collect():
        assert r["n"] == len(r["ids"]) and r["most"] == max(r["tfs"]) and (r["shortest"], r["longest"]) == (min(r["lengths"]), max(r["lengths"])) and r["ids"] == sorted(r["ids"])
        for i, tf, length in zip(r["ids"], r["tfs"], r["lengths"]):
            found[r["block"] * 32 + i, r["word"]] = (tf, length)
    wanted = {}
    for r in whole.assets.collect():
        length = sum(max(0, len(r[c] or "") - 2) for c in text_index.TEXT_COLUMNS)
        for word in re.split(r"[ \t\n\x0b\f\r]+", " ".join((r[c] or "").lower() for c in text_index.TEXT_COLUMNS)):
            if len(word) >= 3:
                wanted[r["id"], word] = (wanted.get((r["id"], word), (0, 0))[0] + 1, length)
    assert found == wanted


def test_no_row_of_an_asset_and_word_is_shuffled_and_folders_have_several_tasks(whole, spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(text_index, "_written", lambda rows, keys, path, *rest, write=text_index._written: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, keys, path, *rest)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = text_index.built(whole.assets, f"file://{tmp_path}", buckets=1, block=256)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "Exchange" not in plans[0]
    assert len(index.postings.inputFiles()) > 1
