"""Behaviour of the catalog: search, browsing, changes, against small fixtures and SQLite's own full-text index."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from phonolith import schema
from phonolith.functions import numbers as N
from phonolith.functions import text as S
from phonolith.operators import audio, browse, search, writes
from phonolith.operators.filters import below_folder, filtered
from phonolith.schema import Catalog, SearchMode, SearchQuery, SortDirection, SortField, ValidationError
from phonolith.sources import snapshots

BASE = dict(path="", filename="f", extension="wav", folder="/", duration_ms=1000, sample_rate=44100, channels=2, bit_depth=16, file_size=100, category="c", publisher="p", favorite=False, rating=0, notes=None, play_count=0, modified_at=1, indexed_at=2)


def library(spark, *rows, tags=(), links=(), vectors=()):
    full = [BASE | {"id": i + 1, "path": f"/{i + 1}.wav"} | r for i, r in enumerate(rows)]
    assets = spark.createDataFrame([tuple(r[c] for c in schema.ASSETS.names) for r in full], schema.ASSETS)
    return Catalog(assets, spark.createDataFrame(list(tags), schema.TAGS), spark.createDataFrame(list(links), schema.ASSET_TAGS), spark.createDataFrame(list(vectors), schema.EMBEDDINGS), spark.createDataFrame([(1, [0.5, 0.25])], schema.PEAKS))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search_text():
    assert S.search_text('(foo):bar^baz*"x"') == "foo bar baz x"
    assert S.search_text("a    b") == "a b" and S.search_text("  ") == ""
    assert S.search_text("and a and or not b not") == "and a b not"
    assert [search.lexical_kind(t) for t in ("abc", "ab", "")] == ["fts", "like", "none"]
    with pytest.raises(ValidationError):
        search.lexical_kind("foot-step", strict=True)


def test_bm25_equals_sqlite(spark):
    texts = ["Footstep_Concrete", "foot foot Footsteps", "Éclair ÉCLAIR door", "door slam", "concrete mixer", "rain on concrete footpath"]
    rows = [dict(filename=t, folder=f"/lib/{i % 2}", category="Foley", publisher="Boom" if i % 2 else None, notes="foot note" if i == 3 else None) for i, t in enumerate(texts)]
    cat = library(spark, *rows)
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(filename, folder, category, publisher, notes, tokenize='trigram')")
    for i, r in enumerate(rows):
        db.execute("insert into t(rowid, filename, folder, category, publisher, notes) values (?, ?, ?, ?, ?, ?)", (i + 1, r["filename"], r["folder"], r["category"], r["publisher"], r["notes"]))
    for text in ("foot", "concrete", "foot concrete", "éclair", "ley", "zzz", "door fo"):
        want = {i: s for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (" ".join(f'"{w}"' for w in text.split()),))}
        if text == "door fo":  # words below three characters are left out here
            want = {i: s for i, s in db.execute("select rowid, bm25(t) from t where t match 'door'")}
        got = {r["id"]: r["score"] for r in search.lexical_candidates(cat, SearchQuery(text)).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in got), text


def test_order_is_worst_first_by_default_and_pages(spark):
    cat = library(spark, dict(filename="door"), dict(filename="door door door"), dict(filename="rain " * 9), *[dict(filename="x" * 9)] * 4)
    assert ids(search.search(cat, SearchQuery("door")).page) == [1, 2] or ids(search.search(cat, SearchQuery("door")).page) == [2, 1]
    worst = ids(search.search(cat, SearchQuery("door")).page)
    assert ids(search.search(cat, SearchQuery("door"), best_first=True).page) == worst[::-1]
    assert ids(search.search(cat, SearchQuery("", sort_by=SortField.NAME, sort_dir=SortDirection.ASC, offset=1, limit=2)).page) == [2, 3]
    found = search.search(cat, SearchQuery(""))
    assert found.total.first()["total"] == 7 and not found.scored
    assert ids(search.search(cat, SearchQuery("a b")).page) == []


def test_duration_nulls_last_both_ways(spark):
    cat = library(spark, dict(duration_ms=None), dict(duration_ms=5), dict(duration_ms=9))
    for direction, want in ((SortDirection.ASC, [2, 3, 1]), (SortDirection.DESC, [3, 2, 1])):
        assert ids(search.search(cat, SearchQuery("", sort_by=SortField.DURATION, sort_dir=direction)).page) == want


def test_filters(spark):
    cat = library(spark, dict(folder="/x"), dict(folder="/x/sub", publisher=""), dict(folder="/x2"), tags=[(1, "Loud")], links=[(2, 1), (3, 1)])
    check = lambda **f: sorted(ids(filtered(cat, SearchQuery(**f))))
    assert check(folder_root="/x") == [1, 2] and check(folder_root="/") == [1, 2, 3] and check(folder_root="") == [] and check(folder_root="/x/") == []
    assert check(tags=["LOUD", "none"]) == [2, 3] and check(tags=[]) == [1, 2, 3] and check(publisher="") == [2] and check(extensions=["WAV"]) == []
    assert cat.assets.where(below_folder("/x")).count() == 2


def test_like_wildcards_and_case(spark):
    cat = library(spark, dict(filename="a%b"), dict(filename="AXB"), dict(filename="ÄB"))
    assert sorted(ids(search.lexical_candidates(cat, SearchQuery("a_")))) == [1, 2]
    assert ids(search.lexical_candidates(cat, SearchQuery("äb"))) == []


def test_vector_and_hybrid(spark):
    vectors = [(1, [1.0, 0.0], "m", 0), (2, [0.0, 2.0], "m", 0), (3, [0.0, 0.0], "m", 0), (4, [1.0, 1.0], "old", 0)]
    cat = library(spark, dict(filename="rain"), dict(filename="door"), dict(filename="rain rain"), dict(filename="rain rain rain"), vectors=vectors)
    got = search.search(cat, SearchQuery("q", SearchMode.VECTOR), vector=[0.0, 3.0], model_id="m")
    assert [(r["id"], round(r["score"], 6)) for r in got.page.collect()] == [(2, 1.0), (1, 0.0), (3, 0.0)]
    both = {r["id"]: r["score"] for r in search.search(cat, SearchQuery("rain", SearchMode.BOTH), vector=[0.0, 3.0], model_id="m").page.collect()}
    assert both.keys() == {1, 2, 3} and math.isclose(both[2], 0.65)
    low = {r["id"]: r["score"] for r in search.lexical_candidates(cat, SearchQuery("rain")).collect()}
    scaled = lambda i: (max(low.values()) - low[i]) / (max(low.values()) - min(low.values()) + 1e-8)
    assert math.isclose(both[1], 0.325 + 0.35 * scaled(1)) and math.isclose(both[3], 0.325 + 0.35 * scaled(3))
    empty = search.search(cat, SearchQuery("q", SearchMode.VECTOR), provider=audio.HashingProvider(2))
    assert empty.total.first()["total"] == 0
    with pytest.raises(ValidationError):
        search.search(cat, SearchQuery("q", SearchMode.VECTOR))


def test_folders(spark):
    cat = library(spark, dict(folder="C:\\lib\\a"), dict(folder="/C:/lib/a/b"), dict(folder="/"), dict(folder="/z"))
    rows = {r["path"]: r for r in browse.folder_tree(cat.assets).collect()}
    assert set(rows) == {"C:", "C:/lib", "C:/lib/a", "C:/lib/a/b", "/z"}
    assert (rows["C:"]["own_count"], rows["C:"]["total_count"], rows["C:/lib/a"]["own_count"], rows["C:/lib/a"]["total_count"]) == (0, 2, 1, 2)
    tree = browse.nested(list(rows.values()))
    assert [n["path"] for n in tree] == ["C:", "/z"] and tree[0]["children"][0]["path"] == "C:/lib"
    assert browse.folder_count(cat.assets, "/").first()[0] == 4 and browse.folder_count(cat.assets, "").first()[0] == 0


def test_ids_follow_the_order_of_values_in_any_partitioning(spark):
    names = [f"{chr(97 + i * 7 % 26)}{i}" for i in range(300)]
    start = spark.createDataFrame([(5,), (None,)], "id long")
    for parts in (1, 9):
        rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, _at int").drop("_at").repartition(parts)
        got = sorted((r["name"], r["id"]) for r in writes.numbered(rows, start, "name").collect())
        assert got == [(n, 6 + i) for i, n in enumerate(sorted(names))]
    assert writes.numbered(rows.limit(0), start, "name").count() == 0
    assert writes.numbered(rows.limit(1), start.limit(0), "name").first()["id"] == 1


def test_changes(spark):
    cat = library(spark, dict(favorite=True, rating=4, notes="mine"), dict())
    new = cat.assets.drop("id", "favorite", "rating", "notes", "play_count")
    more = new.withColumn("path", F.concat(F.lit("/new"), "path")).unionByName(new)
    grown = writes.insert_assets(cat.assets, more.unionByName(more))
    assert sorted((r["id"], r["path"]) for r in grown.collect()) == [(1, "/1.wav"), (2, "/2.wav"), (3, "/new/1.wav"), (4, "/new/2.wav")]
    changed = writes.update_technical(cat.assets, new.where("path = '/1.wav'").withColumn("duration_ms", F.lit(7).cast("long")))
    row = changed.where("id = 1").first()
    assert (row["duration_ms"], row["favorite"], row["rating"], row["notes"]) == (7, True, 4, "mine")
    with pytest.raises(ValidationError):
        writes.set_rating(cat.assets, [], 6)
    flipped, value = writes.toggle_favorite(cat.assets, 1)
    assert value is False and not flipped.where("id = 1").first()["favorite"]
    with pytest.raises(LookupError):
        writes.toggle_favorite(cat.assets, 99)
    tagged = writes.add_tag(writes.add_tag(cat, [1, 2], "Loud"), [2], "lOUD")
    assert [tuple(r) for r in browse.tag_counts(tagged).collect()] == [(1, "Loud", 2)]
    gone = writes.delete_assets(tagged, spark.createDataFrame([(2,)], "id long"))
    assert gone.assets.count() == 1 and gone.asset_tags.count() == 1
    assert browse.tag_counts(writes.remove_tag(gone, 1, 1)).first()["n_assets"] == 0
    assert writes.wiped(tagged).tags.count() == 0
    log = spark.createDataFrame([(1, False, None, 1), (1, None, 2, 2), (1, True, None, 3), (9, True, 1, 1)], "asset_id long, favorite boolean, rating int, at long")
    row = writes.with_user_state(cat.assets, log).where("id = 1").first()
    assert (row["favorite"], row["rating"]) == (True, 2)
    vectors = spark.createDataFrame([(1, [1.0], "m", 1)], schema.EMBEDDINGS)
    with pytest.raises(Exception, match="expected 2 dimensions"):
        writes.upsert_embeddings(vectors.limit(0), vectors, 2).collect()


def test_snapshots(spark, tmp_path):
    cat = library(spark, dict(), tags=[(1, "a")])
    snapshots.write_snapshot(cat, f"{tmp_path}/c")
    snapshots.export_catalog(writes.wiped(cat), f"{tmp_path}/e")
    assert snapshots.read_snapshot(spark, f"{tmp_path}/c").assets.count() == 1
    snapshots.import_catalog(spark, f"{tmp_path}/e", f"{tmp_path}/c")
    assert snapshots.read_snapshot(spark, f"{tmp_path}/c").assets.count() == 0 and snapshots.snapshots(spark, f"{tmp_path}/c").count() == 2


#: root, path, then first folder below the root, the others, name and extension.
PATHS = [
    ("/m", "/m/Northwind/rain.flac", "Northwind", None, "rain", "flac"),
    ("/m", "/m/Northwind/Weather/Storms/rain.flac", "Northwind", "Weather > Storms", "rain", "flac"),
    ("/m", "/m/rain.flac", None, None, "rain", "flac"),
    ("/m/n", "/m/n/one/two/three/four/five.ogg", "one", "two > three > four", "five", "ogg"),
    ("/m", "/m/LOUD.AIFF", None, None, "LOUD", "aiff"),
    ("/m", "/m/Čaj & Žena/šum ~1.mp3", "Čaj & Žena", None, "šum ~1", "mp3"),
    ("/m", "/m/[old] takes/2019, part 3/+steps_.wav", "[old] takes", "2019, part 3", "+steps_", "wav"),
    ("/m", "/m/take.7.of.9.wav", None, None, "take.7.of.9", "wav"),
    ("/m", "/m/NOTES", None, None, "NOTES", ""),
]


def test_parsed_paths(spark):
    rows = spark.createDataFrame([(r, p) for r, p, *_ in PATHS], "root string, path string")
    got = rows.select("path", *[c.alias(n) for n, c in S.parsed_path(F.col("root"), F.col("path")).items()]).collect()
    assert {(r["path"], r["publisher"], r["category"], r["filename"], r["extension"]) for r in got} == {p[1:] for p in PATHS}


def one(spark, *columns):
    return tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(columns)]).first())


def test_labels_at_their_boundaries(spark):
    """A label's unit changes at exactly a minute, an hour, and each power of 1024; tenths never carry into the seconds."""
    ms = lambda v: S.duration_label(F.lit(v).cast("long"))
    assert one(spark, ms(None), ms(49), ms(50), ms(949), ms(950), ms(59_999)) == ("—", "0:00.0", "0:00.1", "0:00.9", "0:00.9", "0:59.9")
    assert one(spark, ms(60_000), ms(3_599_000), ms(3_600_000), ms(36_061_260)) == ("1:00.0", "59:59.0", "1:00:00.0", "10:01:01.3")
    size = lambda v: S.size_label(F.lit(v).cast("long"))
    assert one(spark, size(0), size(1023), size(1024), size(1075), size(1024**2 - 1)) == ("0 B", "1023 B", "1.0 KB", "1.0 KB", "1024.0 KB")
    assert one(spark, size(1024**2), size(1024**3 - 1), size(1024**3), size(7 * 1024**4)) == ("1.0 MB", "1024.0 MB", "1.0 GB", "7168.0 GB")
    rate = lambda v: S.rate_label(F.lit(v))
    assert one(spark, rate(999), rate(1000), rate(11025), rate(22050), rate(44099), rate(192000)) == ("999 Hz", "1.0 kHz", "11.0 kHz", "22.05 kHz", "44.1 kHz", "192.0 kHz")


def test_clips_keep_the_shortest_length(spark):
    """0.05 s is a clip, less is none; the start gives way where the end is cut."""
    clip = lambda a, b, d: N.clamped_clip(F.lit(a), F.lit(b), F.lit(d))
    near = lambda row, want: row is not None and max(abs(row[0] - want[0]), abs(row[1] - want[1])) < 1e-9
    kept = one(spark, clip(1.5, 2.25, 3.0), clip(2.0, 7.0, 3.0), clip(2.9, 7.0, 3.0), clip(4.0, 9.0, 1.0), clip(0.0, 0.0625, 0.0625))
    assert all(near(row, want) for row, want in zip(kept, [(1.5, 2.25), (2.0, 3.0), (2.9, 3.0), (0.95, 1.0), (0.0, 0.0625)]))
    assert one(spark, clip(1.0, 2.0, -1.0), clip(1.0, 2.0, 0.0)) == (None, None)
    defer = lambda end, buffer, full: N.defer_clamp(F.lit(end), F.lit(buffer), F.lit(full))
    assert one(spark, defer(5.0, 4.0, 4.2), defer(4.0, 4.0, 9.0), defer(4.01, 4.0, 9.0), defer(5.0, 4.0, 4.04), defer(5.0, 0.0, 9.0)) == (True, False, True, False, False)


def test_export_names(spark):
    names = one(spark, S.clip_name(F.lit("takes/dawn <2>.aiff"), F.lit(0.0), F.lit(12.3456)), S.full_name(F.lit("q?*|.b.ogg")), S.full_name(F.lit("...")), S.full_name(F.lit("x" * 130 + ".wav")))
    assert names[:2] == ("dawn _2__0.000-12.346s.wav", "q___.b.wav") and names[3] == "x" * 120 + ".wav"
    assert S.unique_name("b.wav", set()) == "b.wav" and S.unique_name("b.wav", {"b.wav", "b_3.wav"}) == "b_2.wav"


def test_levels_and_presets(spark):
    level = lambda db: N.nearest_peak_level(F.lit(10 ** (db / 20)))
    assert one(spark, *map(level, (-40.0, -12.0, -8.0, -4.0, -2.5, -0.9, 6.0))) == (-12, -12, -6, -3, -3, -1, 0)
    assert one(spark, N.linear_to_db(F.lit(-1.0)), N.linear_to_db(F.lit(1.0)), N.linear_to_db(F.lit(float("inf")))) == (-96.0, 0.0, -96.0)
    preset = lambda *v: N.trim_preset(*[F.lit(float(x)) for x in v])
    assert one(spark, preset(-60, 15, 4.009), preset(-60, 15, 4.02), preset(-72, 40, 6), preset(-48, 5, 4)) == ("balanced", "custom", "loose", "custom")
