"""The distributed walk, reading by edges, cancelling, versions and leases."""

import os
import struct
import threading
import time
from dataclasses import replace

import pytest
from phonolith.operators import writes
from phonolith.plans.adapters import catalog
from phonolith.plans.audio_queries import pcm_wav
from phonolith.sources import codecs, control, files, ingest, snapshots
from phonolith.streaming import watch
from pyspark.sql import functions as F

import numpy as np

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "lib"
    for name in ("a/b/c/deep.wav", "a/_under/_take.WAV", ".hidden/x.wav", "a/.x.wav", "top.wav", "no.txt", "empty/none.txt", "bad/gone.wav"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(pcm_wav(np.zeros(100, np.float32), 16))
    os.symlink(root, root / "a" / "loop")
    return str(root)


def names(df, root):
    return {os.path.relpath(r["path"], root) for r in df.collect()}


def test_walk(spark, tree):
    shown = {"a/b/c/deep.wav", "a/_under/_take.WAV", "top.wav", "bad/gone.wav"}
    assert names(files.list_tree(spark, tree), tree) == shown
    assert names(files.list_tree(spark, f"file://{tree}/", skip_hidden=False), tree) == shown | {".hidden/x.wav", "a/.x.wav"}
    row = files.walk(spark, tree).where(F.col("path").endswith("deep.wav")).first()
    assert (row["extension"], row["file_size"], row["modified_at"], row["error"]) == ("wav", 244, int(os.stat(row["path"]).st_mtime), None)
    with pytest.raises(FileNotFoundError):
        files.walk(spark, tree + "/none")
    # The driver makes no listing: the plan reads what tasks have written.
    assert "binaryFile" not in files.walk(spark, tree)._jdf.queryExecution().toString()


def test_a_bad_folder_is_an_error_and_its_files_are_not_missing(spark, tree, monkeypatch):
    none = writes.wiped(catalog(spark, SF))
    first = ingest.ingest(none, tree, now=1, resolution=4)
    assert first.stats.first()["indexed"] == 4
    whole = files.walk

    def failing(spark, root):
        found = whole(spark, root).where(~F.col("path").contains("/bad/"))
        return found.unionByName(spark.createDataFrame([(f"{root}/bad", None, None, None, "denied")], found.schema))

    again = ingest.ingest(first.catalog, tree, now=2, resolution=4, list_with=failing)
    stats = again.stats.first()
    assert (stats["skipped"], stats["missing"], stats["errors"], stats["indexed"]) == (3, 0, 1, 0)
    assert again.catalog.assets.count() == 4 and [r["error"] for r in again.errors.collect()] == ["denied"]


def test_unreadable_folder_of_the_walk_itself(spark, tree, monkeypatch):
    assert [r[5] is not None for r in files._entries(tree + "/none", True)] == [True]


def test_facts_by_edges_equal_those_of_whole_files(tmp_path):
    page = b"OggS" + bytes(22) + b"\x01\x1e" + b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44100) + bytes(14)
    last = b"OggS" + b"\0\4" + struct.pack("<q", 88_200) + bytes(30)
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    tag = lambda n: b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + bytes(n)
    cases = [("ogg", page + bytes(n) + last) for n in (0, 1000, 300_000)] + [("mp3", t + frame * 20) for t in (b"", tag(100), tag(65_400), tag(65_500), tag(200_000))]
    cases += [("ogg", b""), ("ogg", b"x" * 200_000), ("mp3", b""), ("mp3", tag(300)), ("mp3", b"x" * 500)]
    for extension, data in cases:
        path = tmp_path / f"x.{extension}"
        path.write_bytes(data)
        size, read = files.opened(str(path))
        assert codecs.edge_facts(size, read, extension) == codecs.facts_of(data, extension)
    assert codecs.facts_of(cases[2][1], "ogg").duration_ms == 2000


def test_cancelled_ingest_leaves_the_catalog(spark, tree, tmp_path):
    start = replace(writes.wiped(catalog(spark, SF)), assets=catalog(spark, SF).assets.limit(2))
    marker = control.Marker(f"{tmp_path}/stop/here")
    told = []

    def progress(phase, n):
        told.append(phase)
        if phase == "indexing":
            marker.set()

    with pytest.raises(control.Cancelled):
        ingest.ingest(start, tree, now=1, progress=progress, cancel=marker)
    assert told == ["enumerating", "indexing"] and start.assets.count() == 2
    with pytest.raises(control.Cancelled):
        ingest.ingest_roots(start, [tree], cancel=marker)
    # Tasks themselves stop.
    assert files.extract(files.list_tree(spark, tree), 4, marker).count() == 0


def test_writers_of_one_version(spark, tmp_path):
    base, cat = f"file://{tmp_path}/base", catalog(spark, SF)
    with pytest.raises(FileNotFoundError):
        snapshots.read_version(spark, base)
    assert snapshots.commit(cat, base, 0) == 1
    for expected in (0, 2):
        with pytest.raises(snapshots.Conflict):
            snapshots.commit(cat, base, expected)
    assert snapshots.commit(writes.wiped(cat), base, 1) == 2
    assert snapshots.read_version(spark, base).catalog.assets.count() == 0
    assert snapshots.read_version(spark, base, 1).catalog.assets.count() == cat.assets.count()


def test_one_of_many_makes_a_file(spark, tmp_path):
    made = []
    threads = [threading.Thread(target=lambda: made.append(snapshots.create_once(spark, f"file://{tmp_path}/x/once", "1"))) for _ in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(made) == 1 and os.listdir(tmp_path / "x") == ["once"]


def test_leases(spark, tmp_path):
    base, cat = f"file://{tmp_path}/base", writes.wiped(catalog(spark, SF))
    first = snapshots.lease(spark, base, 60, now=1000)
    assert first.fence == 1 and snapshots.lease(spark, base, 60, now=1059) is None
    second = snapshots.lease(spark, base, 60, now=1061)
    assert second.fence == 2
    # The first one's holder slept too long: the fencing number refuses it.
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(cat, base, 0, first)
    assert snapshots.commit(cat, base, 0, second) == 1
    second.release(spark)
    assert snapshots.lease(spark, base, 60, now=1062).fence == 3


def test_a_burst_is_one_event_and_a_deletion_is_one(spark, tree):
    told, now = [], [0.0]
    state = watch.Debounce(spark, tree, told.append, quiet=3.0, clock=lambda: now[0])

    def tick(seconds):
        now[0] += seconds
        state.look()

    def write(name):
        with open(os.path.join(tree, name), "wb") as out:
            out.write(b"RIFF")

    tick(5)
    for name in ("n1.wav", "n2.wav", "n3.wav"):
        write(name)
        tick(2)
    os.remove(os.path.join(tree, "n3.wav"))
    os.utime(os.path.join(tree, "top.wav"), (5, 5))
    tick(2)
    tick(2)
    assert told == []
    tick(2)
    assert told == [{"new": 2, "changed": 1}]
    os.remove(os.path.join(tree, "n1.wav"))
    tick(1)
    tick(3)
    tick(9)
    assert told == [{"new": 2, "changed": 1}, {"missing": 1}]


def test_a_stream_tells_of_a_burst(spark, tree, tmp_path):
    told = []
    query = watch.watch_debounced(spark, tree, f"{tmp_path}/checkpoint", told.append, quiet=0.5, every="200 milliseconds")
    try:
        for i in range(4):
            with open(os.path.join(tree, f"burst {i}.wav"), "wb") as out:
                out.write(b"RIFF")
        until = time.monotonic() + 90
        while not told and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert told and sum(t["new"] for t in told) == 4


def test_a_late_writer_is_refused_before_it_writes(spark, tmp_path):
    cat, base = catalog(spark, SF), f"file://{tmp_path}"
    snapshots.commit(cat, base, 0)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(cat, base, 0)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("snapshot-")]) == 1
