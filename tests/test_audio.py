"""WAVE bytes, kernels, ingest and streaming, on generated files."""

import os
import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.functions import kernels as K
from phonolith.functions.kernels import PostProcess
from phonolith import schema
from phonolith.operators import audio, signal, writes
from phonolith.schema import Catalog
from phonolith.sources import codecs, config, files, ingest, wav
from phonolith.streaming import watch


def sine(hz, rate, seconds):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate).astype(np.float32)


def pcm(x, rate=44100, bits=16, channels=1):
    x = np.repeat(np.asarray(x)[:, None], channels, axis=1)
    ints = np.round(x * (2 ** (bits - 1) - 1)).astype("<i4")
    body = ints.astype("<i2").tobytes() if bits == 16 else ints.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() if bits == 24 else ((ints + 128).astype(np.uint8).tobytes() if bits == 8 else ints.tobytes())
    align = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * align, align, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("bits", [8, 16, 24])
@pytest.mark.parametrize("channels", [1, 2])
def test_decode(bits, channels):
    x = sine(440, 8000, 0.1)
    data = pcm(x, 8000, bits, channels)
    header = wav.sniff(data)
    assert (header.channels, header.sample_rate, header.bits_per_sample, header.frames, header.duration_ms) == (channels, 8000, bits, 800, 100)
    got, rate = wav.decode_linear(data)
    assert rate == 8000 and got.shape == (800, channels) and np.abs(got[:, 0] - x).max() < 2 ** (2 - bits)


def test_bad_files():
    for data in (b"", b"xxx", b"not a wav", b"\0" * 64, b"RIFF\0\0\0\0WAVE"):
        assert wav.sniff(data) is None and wav.decode_linear(data) is None
    with pytest.raises(ValueError):
        wav.decode(pcm(np.zeros(0)), "wav")


def test_float_file_and_loop_points():
    x = sine(220, 8000, 0.5)[:, None]
    data = wav.float_wav(x, 8000, (100, 3999))
    got, rate = wav.decode_linear(data)
    assert rate == 8000 and np.array_equal(got, x)
    at = data.index(b"smpl")
    assert struct.unpack_from("<2I", data, at + 52) == (100, 3999) and len(data) == at + 8 + struct.unpack_from("<I", data, at + 4)[0]


def test_peaks():
    assert K.peak_pairs(sine(440, 44100, 1), 100).shape == (100, 2)
    assert np.abs(K.peak_pairs(np.zeros(500, np.float32), 20)).max() == 0
    x = np.arange(10, dtype=np.float32) / 10
    assert np.allclose(K.peak_pairs(x, 3), [[0, 0.2], [0.3, 0.5], [0.6, 0.9]])
    assert np.allclose(K.peak_pairs(x[:2], 4), [[0, 0], [0.1, 0.1], [0, 0], [0, 0]])
    with pytest.raises(ValueError):
        K.peak_pairs(x, 0)


def test_silence_bounds_equal_their_definition():
    """An edge goes where no window's peak reaches the threshold, if its run is long enough."""
    rng = np.random.default_rng(8)
    for case in range(60):
        rate, window_ms, least_ms = int(rng.choice([8000, 11025, 32000])), float(rng.choice([1, 2, 5])), float(rng.choice([1, 20]))
        parts = [rng.uniform(-1e-4, 1e-4, rng.integers(0, 900)), rng.uniform(-0.8, 0.8, rng.integers(0, 700)), rng.uniform(-1e-4, 1e-4, rng.integers(0, 900))]
        x = np.concatenate(parts)
        if not len(x):
            continue
        half = max(1, round(window_ms / 1000 * rate) // 2)
        loud = np.array([np.abs(x[max(0, i - half) : i + half + 1]).max() >= 10 ** (-50 / 20) for i in range(len(x))])
        a, b = K.silence_bounds(x, rate, -50, least_ms, window_ms)
        if not loud.any():
            assert (a, b) == (0, 0)
            continue
        first, last, least = int(np.argmax(loud)), len(x) - int(np.argmax(loud[::-1])), int(np.ceil(least_ms / 1000 * rate))
        # The window's size is rounded: one frame either way.
        assert abs(a - (first if first >= least else 0)) <= 1 or abs(first - least) <= 1
        assert abs(b - (last if len(x) - last >= least else len(x))) <= 1 or abs(len(x) - last - least) <= 1
    assert len(K.trim(np.ones((7, 2)), 0, 0)) == 7


def test_sliding_peak_equals_brute_force():
    x = np.random.default_rng(1).random(200)
    for half in (1, 2, 7, 60, 300):
        assert np.array_equal(K.sliding_peak(x, half), [x[max(0, i - half) : i + half + 1].max() for i in range(200)])


def test_classify():
    assert K.classify(sine(440, 44100, 2), 44100)[2] == 2
    noise = np.random.default_rng(3).uniform(-1, 1, 176400).astype(np.float32)
    assert K.classify(noise, 44100)[2] == 0
    assert K.classify(np.zeros(100), 44100) == (0.0, 0.0, 0)
    x = noise[:500]
    direct = np.array([x[: 500 - k] @ x[k:] for k in range(500)])
    assert np.allclose(K.autocorrelation(x), direct / direct[0], atol=1e-4)


@pytest.mark.parametrize("x", [sine(220, 44100, 3), sine(440, 8000, 1) * 0.3, np.random.default_rng(5).uniform(-1, 1, 30000).astype(np.float32)])
def test_loops_have_no_click(x):
    x = np.repeat(x[:, None], 2, axis=1)
    found = K.post_process(x, 44100, PostProcess(make_loopable=True, crossfade_sec=0.2, trim_silence=True, normalize_peak=True))
    assert np.abs(found.samples[0] - found.samples[-1]).max() < 1e-3 and found.loop_end == len(found.samples) - 1
    auto = K.post_process(x, 44100, PostProcess(make_loopable=True))
    assert len(auto.samples) >= len(x) // 2 - 200 and auto.technique != "passthrough"


def test_split_swap_length_and_short_signals():
    x = np.ones((1000, 1), np.float32)
    assert len(K.split_swap(x, 1000, 0.1).samples) == 900
    for frames in (1, 2, 3, 4, 5):
        assert K.post_process(x[:frames], 1000, PostProcess(make_loopable=True)).technique == "passthrough"
    with pytest.raises(ValueError):
        K.post_process(x[:0], 1000, PostProcess())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "lib"
    for name, data in {"Boom/Impacts/a.wav": pcm(sine(440, 8000, 0.5), 8000), "Boom/B.WAV": pcm(sine(220, 8000, 0.2), 8000, channels=2), "c.mp3": b"xxx", "d.txt": b"", ".hidden/e.wav": pcm(sine(1, 8000, 0.1)), "_f.wav": pcm(np.zeros(10))}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


def test_ingest(spark, tree):
    listing = files.list_local(spark, tree)
    names = lambda df: {os.path.relpath(r["path"], tree) for r in df.collect()}
    assert names(listing) == {"Boom/Impacts/a.wav", "Boom/B.WAV", "c.mp3", "_f.wav"}
    assert names(files.list_files(spark, tree)) == {"Boom/Impacts/a.wav", "Boom/B.WAV", "c.mp3"}
    assert ".hidden/e.wav" in names(files.list_local(spark, tree, skip_hidden=False))
    with pytest.raises(FileNotFoundError):
        files.list_local(spark, tree + "/none")
    listing = files.list_files(spark, tree)
    none = listing.select("path", "modified_at").limit(0)
    diff = files.difference(listing, none, tree)
    facts = files.extract(diff.where("status = 'new'"), 20).cache()
    assert {r["error"] is None for r in facts.where(F.col("path").endswith("mp3")).collect()} == {False}
    rows = {r["filename"]: r for r in files.asset_rows(listing, facts, tree, 9).collect()}
    assert (rows["a"]["publisher"], rows["a"]["category"], rows["a"]["duration_ms"], rows["B"]["channels"], len(rows["a"]["peaks"])) == ("Boom", "Impacts", 500, 2, 40)
    assert tuple(files.scan_stats(diff, facts.where("error IS NOT NULL")).first()) == (2, 0, 0, 1)
    again = listing.withColumn("modified_at", F.when(F.col("path").endswith("a.wav"), 1).otherwise(F.col("modified_at"))).where(~F.col("path").endswith("mp3"))
    gone = spark.createDataFrame([(tree + "/gone.wav", 1), (tree + "2/other.wav", 1)], "path string, modified_at long")
    states = {os.path.basename(r["path"]): r["status"] for r in files.difference(listing, again.select("path", "modified_at").unionByName(gone), tree).collect()}
    assert states == {"a.wav": "changed", "B.WAV": "unchanged", "c.mp3": "new", "gone.wav": "missing"}


def test_clips_and_reports(spark, tree):
    paths = files.list_files(spark, tree).where("extension = 'wav'")
    contents = files.read_contents(paths).cache()
    assert {r["error"] for r in contents.collect()} == {None} and {len(r["content"]) for r in contents.collect()} == {44 + 8000, 44 + 6400}
    clip = contents.withColumn("start", F.lit(0.0)).withColumn("end", F.lit(0.1))
    rows = {os.path.basename(r["path"]): r for r in audio.clips(clip).collect()}
    assert rows["a.wav"]["frames"] == 800 and len(rows["a.wav"]["wav"]) == 44 + 800 * 4
    short = audio.clips(clip.withColumn("end", F.lit(0.02))).first()
    assert short["wav"] is None and "short" in short["error"]
    whole = contents.withColumn("start", F.lit(None).cast("double")).withColumn("end", F.lit(None).cast("double"))
    looped = {os.path.basename(r["path"]): r for r in audio.clips(whole, PostProcess(make_loopable=True, embed_smpl_chunk=True)).collect()}
    assert b"smpl" in looped["a.wav"]["wav"]
    assert {r["frames"] for r in audio.decode_reports(contents).collect()} == {4000, 1600}
    reports = {r["path"]: r for r in audio.decode_reports(paths.select("path").unionByName(spark.createDataFrame([("/none/x.wav",)], "path string"))).collect()}
    assert sorted(r["frames"] or 0 for r in reports.values()) == [0, 1600, 4000] and "x.wav" in reports["/none/x.wav"]["error"]


def test_only_new_and_changed_files_are_opened(spark, tree):
    """A file that cannot be read but has not changed is no error; a changed one is."""
    empty = Catalog(*(spark.createDataFrame([], s) for s in (schema.ASSETS, schema.TAGS, schema.ASSET_TAGS, schema.EMBEDDINGS, schema.PEAKS)))
    told = []
    # Spark's own listing, which leaves names with _ out.
    first = ingest.ingest(empty, tree, resolution=3, now=5, progress=lambda *t: told.append(t), list_with=files.list_files)
    assert told == [("enumerating", 3), ("indexing", 3), ("complete", 3)]
    assert tuple(first.stats.select("indexed", "skipped", "missing", "errors").first()) == (2, 0, 0, 1)
    assert first.catalog.peaks.select(F.size("peaks")).distinct().collect() == [(6,)]
    mine = replace(first.catalog, assets=writes.set_rating(first.catalog.assets, [1, 2], 4))
    quiet, loud = os.path.join(tree, "Boom/B.WAV"), os.path.join(tree, "Boom/Impacts/a.wav")
    for path, time in ((quiet, os.stat(quiet).st_mtime), (loud, os.stat(loud).st_mtime + 50)):
        with open(path, "wb") as f:
            f.write(pcm(sine(300, 8000, 1.0), 8000) if path == loud else b"no audio any more")
        os.utime(path, (time, time))
    os.remove(os.path.join(tree, "c.mp3"))
    again = ingest.ingest(mine, tree, resolution=3, now=6, list_with=files.list_files)
    assert tuple(again.stats.select("indexed", "skipped", "missing", "errors").first()) == (1, 1, 0, 0)
    rows = {r["filename"]: r for r in again.catalog.assets.collect()}
    assert (rows["a"]["duration_ms"], rows["a"]["rating"], rows["a"]["indexed_at"], rows["B"]["indexed_at"]) == (1000, 4, 6, 5)
    os.remove(quiet)
    gone = ingest.ingest_roots(again.catalog, [tree, tree + "/none"], now=7, list_with=files.list_files)
    assert gone.catalog.assets.count() == gone.catalog.peaks.count() == 1
    assert [(r["missing"], r["errors"]) for r in gone.stats.collect()] == [(1, 0), (0, 1), (1, 1)]


def test_headers_of_other_formats():
    x = np.array([0.5, -0.5, 0.25, -1.0], np.float32)
    common = b"COMM" + struct.pack(">IHIHHQ", 18, 2, 2, 24, 16383 + 14, 22050 << 49)
    body = b"".join(int(v * 8388608).to_bytes(3, "big", signed=True) for v in x)
    aiff = b"FORM" + struct.pack(">I", 0) + b"AIFF" + common + b"SSND" + struct.pack(">III", 8 + len(body), 0, 0) + body
    y, rate = codecs.decode(aiff, "aiff")
    assert rate == 22050 and np.array_equal(y, x.reshape(2, 2)) and codecs.facts_of(aiff, "aif") == codecs.Facts(22050, 2, 24, 2)
    flac = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + (48000 << 44 | 1 << 41 | 23 << 36 | 96000).to_bytes(8, "big") + bytes(16)
    assert codecs.facts_of(flac, "flac") == codecs.Facts(48000, 2, 24, 96000) and codecs.facts_of(flac, "flac").duration_ms == 2000
    page = lambda at, data: b"OggS\0\0" + struct.pack("<qIII", at, 1, 0, 0) + bytes([1, len(data)]) + data
    ogg = page(0, b"\x01vorbis" + struct.pack("<IBI", 0, 1, 44100) + bytes(15)) + page(88200, b"x")
    assert codecs.facts_of(ogg, "ogg") == codecs.Facts(44100, 1, None, 88200)
    mp3 = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(32) + b"Xing" + struct.pack(">II", 1, 100) + bytes(1000)
    assert codecs.facts_of(b"ID3\x03\0\0\0\0\0\x02ab" + mp3, "mp3") == codecs.Facts(44100, 2, None, 115200)
    assert codecs.facts_of(mp3.replace(b"Xing", b"none"), "mp3").frames == (len(mp3)) * 8 * 44100 // 128000
    for kind in codecs.READERS:
        assert codecs.facts_of(b"", kind) is None and codecs.facts_of(b"RIFFFORMfLaCOggS" * 4, kind) is None
    with pytest.raises(ValueError):
        codecs.decode(flac, "flac")


def test_long_form_equals_kernels(spark):
    x = np.concatenate([np.zeros(300), sine(50, 1000, 1) * 0.8, np.zeros(200)]).astype(np.float32)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "asset_id long, frame long, sample double")
    assert tuple(signal.silence_bounds(rows, 1000, -40, 15, 4).first())[1:] == K.silence_bounds(x, 1000, -40, 15, 4)
    got = sorted((r["bucket"], r["low"], r["high"]) for r in signal.peaks(rows, 7).collect())
    assert np.allclose([g[1:] for g in got], K.peak_pairs(x, 7))
    assert [r["frame"] for r in signal.zero_crossings(rows).orderBy("frame").collect()] == K.rising_zeros(x, 0, len(x)).tolist()


@pytest.mark.parametrize("block", [1, 7, 64])
def test_windows_over_blocks_equal_whole_signals(spark, monkeypatch, block):
    x = np.concatenate([np.zeros(60), sine(50, 1000, 0.2) * 0.8, np.zeros(40)]).astype(np.float32)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "asset_id long, frame long, sample double")
    monkeypatch.setattr(signal, "BLOCK_FRAMES", block)
    assert tuple(signal.silence_bounds(rows, 1000, -40, 15, 4).first())[1:] == K.silence_bounds(x, 1000, -40, 15, 4)
    assert [r["frame"] for r in signal.zero_crossings(rows).orderBy("frame").collect()] == K.rising_zeros(x, 0, len(x)).tolist()
    lag = 9
    assert np.isclose(signal.amdf(rows, lag).first()["amdf"], np.abs(x[:-lag].astype(float) - x[lag:]).mean())
    assert np.isclose(signal.autocorrelation(rows, lag).first()["autocorrelation"], K.autocorrelation(x)[lag], atol=1e-4)


def test_normalized_rows(spark):
    rows = spark.createDataFrame([(1, 0, 0.25, 7), (1, 1, -0.5, 7), (2, 0, 0.0, 7), (None, 0, 0.1, 7)], "asset_id long, frame long, sample double, extra int")
    got = signal.normalized(rows, 1.0)
    assert got.columns == rows.columns
    assert sorted((r["asset_id"] or 0, r["frame"], r["sample"]) for r in got.collect()) == [(0, 0, 1.0), (1, 0, 0.5), (1, 1, -1.0), (2, 0, 0.0)]


def test_watch_and_chunks(spark, tree, tmp_path):
    seen = []
    query = watch.watch(spark, tree, str(tmp_path / "ck"), seen.append, available_now=True)
    query.awaitTermination(60)
    assert sum(seen) == 3
    rows = spark.createDataFrame([(1, i, 0.5) for i in range(45)], "asset_id long, frame long, sample double")
    assert sorted((r["chunk"], r["n_frames"]) for r in watch.chunked(rows, 10).collect()) == [(0, 20), (1, 20), (2, 5)]
    flight = watch.SingleFlight()
    with flight.start() as first, flight.start() as second:
        assert first and not second
    with flight.start() as third:
        assert third


def test_settings(tmp_path):
    path = str(tmp_path / "c.toml")
    assert config.load_settings(path) == config.Settings()
    (tmp_path / "c.toml").write_text("[indexing]\npeak_resolution = 5\n[other]\nx = 1\n")
    assert config.load_settings(path).indexing == config.Indexing(peak_resolution=5)
    config.save_settings(config.load_settings(path), path)
    assert config.load_settings(path).indexing.peak_resolution == 5
    for wrong in ("[indexing\n", "indexing = 1\n", "[indexing]\npeak_resolution = 'x'\n"):
        (tmp_path / "c.toml").write_text(wrong)
        with pytest.raises(config.ValidationError):
            config.load_settings(path)


@pytest.mark.parametrize("block,lags", [(64, 10), (64, 999), (7, 30), (4096, 999)])
def test_autocorrelation_in_blocks_equals_one_array(spark, block, lags):
    rng = np.random.default_rng(4)
    signals = {1: rng.normal(size=1000), 2: sine(50, 1000, 0.3), 3: np.ones(1)}
    rows = [(i, k, float(v)) for i, x in signals.items() for k, v in enumerate(x)]
    found = signal.autocorrelation(spark.createDataFrame(rows, "asset_id long, frame long, sample double").repartition(4), lags, block).collect()
    assert len(found) == sum(min(lags, len(x) - 1) + 1 for x in signals.values())
    for i, x in signals.items():
        own = {r["lag"]: r["value"] for r in found if r["asset_id"] == i}
        direct = [x[: len(x) - k] @ x[k:] for k in range(len(own))]
        assert np.allclose([own[k] for k in range(len(own))], direct, atol=1e-9)
        assert np.allclose(np.array(direct) / direct[0], K.autocorrelation(x)[: len(own)], atol=1e-4)


def test_autocorrelation_at_one_lag_and_at_all_lags(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, -1.0, 3.0])] + [(2, 0, 0.0), (2, 1, 0.0)], "asset_id long, frame long, sample double")
    assert sorted(map(tuple, signal.autocorrelation(rows, 2).collect())) == [(1, pytest.approx(5 / 15)), (2, None)]
    assert [round(r["value"], 9) for r in signal.autocorrelation(rows, 2, 2).where("asset_id = 1").orderBy("lag").collect()] == [15.0, -3.0, 5.0]


def test_the_query_of_one_lag_has_the_columns_of_its_sql(spark):
    from phonolith.plans import catalog_queries

    assert catalog_queries.QUERIES["signal_autocorr_lag"](spark, "/root/testdata/sf0.001").columns == ["asset_id", "r"]


def test_hashed_words_are_remembered_and_the_sums_stay_the_same(monkeypatch):
    import hashlib
    import pickle

    from phonolith.operators import audio

    def plain(text, dim):
        v = np.zeros(dim, np.float32)
        for word in text.lower().split():
            for part in {word, *(word[i : i + 3] for i in range(len(word) - 2))}:
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
        norm = float(np.linalg.norm(v))
        return (v / norm if norm > 1e-8 else v).tolist()

    texts = ["the cat the CAT aa", "", "x" * 500 + " the", " ".join(f"w{i % 37}" for i in range(300))]
    for words_bytes, chunk in ((64 << 20, 4096), (4 * 16 * 20, 16)):
        monkeypatch.setattr(audio.HashingProvider, "WORDS_BYTES", words_bytes)
        monkeypatch.setattr(audio.HashingProvider, "CHUNK", chunk)
        provider = pickle.loads(pickle.dumps(audio.HashingProvider(16)))
        assert provider.embed(texts) == [plain(t, 16) for t in texts]
    asked = []
    monkeypatch.setattr(audio.hashlib, "blake2b", lambda data, digest_size, real=hashlib.blake2b: (asked.append(data), real(data, digest_size=digest_size))[1])
    audio.HashingProvider(16).embed(["the the the", "the"])
    assert len(asked) == 1
