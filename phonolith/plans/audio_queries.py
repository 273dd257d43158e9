"""Registered queries over signals, files, ingest and streams, with their SQL.

Signals are the events in blocks of ``FRAMES``: a tone with noise from the
values between silent edges. Blocks are of that size whatever the table, so
gathering one into a row is bounded.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.functions import kernels as K
from phonolith.functions import numbers as N
from phonolith.operators import audio, writes
from phonolith.plans.adapters import ASSETS_SQL, assets, catalog, table
from phonolith.schema import PEAKS, Catalog
from phonolith.sources import codecs, control, files, snapshots, wav
from phonolith.sources.ingest import ingest, ingest_roots
from phonolith.sources.scratch import scratch_folder
from phonolith.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FRAMES, RATE = 1000, 8000
INNER = slice(30, 970)

WAVES_SQL = f"""waves AS (
  SELECT asset_id, frame, CAST(CASE WHEN frame < 20 + asset_id % 5 OR frame >= 980 - asset_id % 3 THEN 0
    ELSE round(0.5e0 * sin(2 * pi() * frame / (40 + asset_id % 7)) + (CAST(floor(value * 100) AS BIGINT) % 101 - 50) / 1000, 4) END AS FLOAT) AS sample
  FROM (SELECT event_id // {FRAMES} AS asset_id, event_id % {FRAMES} AS frame, value FROM events)),
sizes AS (SELECT asset_id, count(*) AS n FROM waves GROUP BY asset_id)"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, frame, sample)"""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / FRAMES).alias("asset_id"), (F.col("event_id") % FRAMES).alias("frame"), "value")
    tone = 0.5 * F.sin(2 * F.pi() * F.col("frame") / (40 + F.col("asset_id") % 7)) + (F.floor(F.col("value") * 100) % 101 - 50) / 1000
    silent = (F.col("frame") < 20 + F.col("asset_id") % 5) | (F.col("frame") >= 980 - F.col("asset_id") % 3)
    return rows.select("asset_id", "frame", F.when(silent, 0.0).otherwise(F.round(tone, 4)).cast("float").alias("sample"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, samples): a row for each block."""
    by_frame = F.array_sort(F.collect_list(F.struct("frame", "sample")))
    return waves(spark, sf_dir).groupBy("asset_id").agg(F.transform(by_frame, lambda x: x["sample"]).alias("samples"))


def each(df: DataFrame, one: Callable[[int, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """The rows of one(asset_id, samples) for each signal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = one(batch.column(0)[i].as_py(), np.array(batch.column(1)[i].values, np.float32))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=[f.split()[0] for f in schema.split(", ")])

    return df.mapInArrow(run, schema)


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str, views: str = WAVES_SQL) -> None:
    QUERIES[name] = query
    head = f"WITH {views}" if views else "WITH"
    body = sql.strip()
    if body.startswith("WITH "):
        ORACLE[name] = f"{head}{', ' if views else ' '}{body[5:]}"
    else:
        ORACLE[name] = f"{head} {body}" if views else body


def add_kernel(name: str, one: Callable[[int, np.ndarray], list[tuple]], schema: str, sql: str, *rounded: str) -> None:
    """A kernel over every signal; its float columns are rounded to 4 places (the SQL does the same)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = each(signals(spark, sf_dir), one, schema)
        # Adding 0 makes a negative zero positive.
        return found.select(*[(F.round(c, 4) + 0.0).alias(c) if c in rounded else F.col(c) for c in found.columns])

    add(name, query, sql)


# --- bytes of files ------------------------------------------------------------------


def pcm_wav(x: np.ndarray, bits: int) -> bytes:
    """Linear PCM of one channel."""
    whole = np.floor(x.astype(np.float64) * (2 ** (bits - 1) - 1) + 0.5).astype(np.int64) + (128 if bits == 8 else 0)
    body = whole.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE * bits // 8, bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def pcm_aiff(x: np.ndarray) -> bytes:
    """16-bit AIFF of one channel."""
    body = np.floor(x.astype(np.float64) * 32767 + 0.5).astype(">i2").tobytes()
    rate = struct.pack(">HQ", 16383 + RATE.bit_length() - 1, RATE << 64 - RATE.bit_length())
    common = b"COMM" + struct.pack(">IHIH", 18, 1, len(x), 16) + rate
    return b"FORM" + struct.pack(">I", 4 + len(common) + 16 + len(body)) + b"AIFF" + common + b"SSND" + struct.pack(">III", 8 + len(body), 0, 0) + body


class BitWriter:
    """Numbers of given widths, one after the other."""

    def __init__(self):
        self.bits: list[str] = []

    def put(self, value: int, width: int) -> None:
        if width:
            self.bits.append(format(value & (1 << width) - 1, f"0{width}b"))

    def rice(self, values, parameter: int) -> None:
        for v in values:
            folded = 2 * v if v >= 0 else -2 * v - 1
            self.bits.append("0" * (folded >> parameter) + "1")
            self.put(folded, parameter)

    def data(self) -> bytes:
        whole = "".join(self.bits)
        whole += "0" * (-len(whole) % 8)
        return int(whole, 2).to_bytes(len(whole) // 8, "big")


def flac_subframe(out: BitWriter, x: list[int], bits: int, kind: str) -> None:
    """One channel: constant, verbatim, by a fixed predictor (fixed0 to fixed4), or by one with weights (2, -1)."""
    if kind == "constant":
        out.put(0, 8)
        out.put(x[0], bits)
    elif kind == "verbatim":
        out.put(2, 8)
        for v in x:
            out.put(v, bits)
    else:
        order = 2 if kind == "linear" else int(kind[-1])
        out.put((32 + order - 1 if kind == "linear" else 8 + order) << 1, 8)
        for v in x[:order]:
            out.put(v, bits)
        if kind == "linear":
            out.put(3, 4)
            out.put(1, 5)
            out.put(4, 4)
            out.put(-2, 4)
            rest = [v - (4 * b - 2 * a >> 1) for a, b, v in zip(x, x[1:], x[2:])]
        else:
            rest = np.diff(np.array(x, np.int64), n=order).tolist()
        # Two partitions if the block can be halved, each with its own parameter; the second one plain at times.
        parts = [rest] if len(x) % 2 or len(x) // 2 < order else [rest[: len(x) // 2 - order], rest[len(x) // 2 - order :]]
        out.put(0, 2)
        out.put(len(parts) - 1, 4)
        for p, part in enumerate(parts):
            mean = sum(map(abs, part)) // max(1, len(part))
            if p and kind == "fixed1":
                out.put(15, 4)
                out.put(20, 5)
                for v in part:
                    out.put(v, 20)
            else:
                out.put(parameter := min(14, mean.bit_length()), 4)
                out.rice(part, parameter)


def crc(data: bytes, polynomial: int, width: int) -> int:
    value = 0
    for byte in data:
        value ^= byte << width - 8
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value >> width - 1 else 0)) & (1 << width) - 1
    return value


def flac_file(x: np.ndarray, rate: int, block: int, kinds: list[str], layout: int | None = None, bits: int = 16) -> bytes:
    """Whole-number frames x channels as a FLAC file; kinds of subframes take turns."""
    channels = x.shape[1]
    layout = channels - 1 if layout is None else layout
    raw = x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
    facts = (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | len(x)).to_bytes(8, "big")
    out = [b"fLaC", b"\x80\x00\x00\x22", struct.pack(">HH", block, block), bytes(6), facts, hashlib.md5(raw).digest()]
    for number, at in enumerate(range(0, len(x), block)):
        part = x[at : at + block]
        left, right = part[:, 0], part[:, -1]
        own = {8: (left, left - right), 9: (left - right, right), 10: (left + right >> 1, left - right)}.get(layout, part.T)
        head = bytes([0xFF, 0xF8, 0x70, layout << 4 | {16: 8, 24: 12}[bits]]) + chr(number).encode() + struct.pack(">H", len(part) - 1)
        frame = BitWriter()
        for c, values in enumerate(own):
            side = (layout == 9 and c == 0) or (layout in (8, 10) and c == 1)
            kind = kinds[(number + c) % len(kinds)]
            kind = "constant" if len(set(values.tolist())) == 1 else "verbatim" if len(values) < 5 else kind
            flac_subframe(frame, values.tolist(), bits + side, kind)
        head += bytes([crc(head, 0x07, 8)])
        body = head + frame.data()
        out += [body, struct.pack(">H", crc(body, 0x8005, 16))]
    return b"".join(out)


def float_bytes(x: np.ndarray) -> bytes:
    return wav.float_wav(x[:, None], RATE)


def header_row(i: int, x: np.ndarray) -> list[tuple]:
    h = wav.sniff(float_bytes(x))
    return [(i, h.audio_format, h.channels, h.sample_rate, h.bits_per_sample, h.data_size, h.frames, h.duration_ms)]


add_kernel(
    "wav_header",
    header_row,
    "asset_id long, format long, channels long, sample_rate long, bits long, data_size long, frames long, duration_ms long",
    f"SELECT asset_id, CAST(3 AS BIGINT) AS format, CAST(1 AS BIGINT) AS channels, CAST({RATE} AS BIGINT) AS sample_rate, CAST(32 AS BIGINT) AS bits, 4 * n AS data_size, n AS frames, n * 1000 // {RATE} AS duration_ms FROM sizes",
)


def decoded_row(i: int, x: np.ndarray) -> list[tuple]:
    bits = (8, 16, 24, 32, 0)[i % 5]
    y, rate = wav.decode(pcm_wav(x, bits) if bits else float_bytes(x), "wav")
    return [(i, bits, rate, len(y), float(y.min()), float(y.max()), float(y.astype(np.float64).sum()))]


add_kernel(
    "wav_decode",
    decoded_row,
    "asset_id long, bits long, sample_rate long, frames long, low double, high double, total double",
    f"""WITH b AS (SELECT asset_id, CAST(sample AS DOUBLE) AS s, CAST([8, 16, 24, 32, 0] AS BIGINT[])[asset_id % 5 + 1] AS bits FROM waves),
    d AS (SELECT asset_id, bits, CASE WHEN bits = 0 THEN s ELSE floor(s * (pow(2e0, bits - 1) - 1) + 0.5e0) / pow(2e0, bits - 1) END AS y FROM b)
    SELECT asset_id, bits, CAST({RATE} AS BIGINT) AS sample_rate, count(*) AS frames, round(min(y), 4) AS low, round(max(y), 4) AS high, round(sum(y), 4) AS total FROM d GROUP BY asset_id, bits""",
    "low",
    "high",
    "total",
)


def flac_row(i: int, x: np.ndarray) -> list[tuple]:
    """Two channels, one the other's reverse, through every kind of subframe and channel layout."""
    left = np.floor(x.astype(np.float64) * 32767 + 0.5).astype(np.int64)
    kinds = ["fixed2", "linear", "fixed0", "verbatim", "fixed1", "fixed3", "fixed4"]
    data = flac_file(np.stack([left, left[::-1]], axis=1), RATE, 192, kinds[i % 7 :] + kinds[: i % 7], (1, 8, 9, 10)[i % 4])
    facts, (y, rate) = codecs.facts_of(data, "flac"), codecs.decode(data, "flac")
    whole = np.rint(y.astype(np.float64) * 32768).astype(np.int64)
    places = np.arange(1, len(y) + 1)
    return [(i, facts.channels, facts.bit_depth, facts.duration_ms, rate, len(y), int(whole[:, 0].max()), int((whole[:, 0] * places).sum()), int((whole[:, 1] * places).sum()))]


add_kernel(
    "flac_decode",
    flac_row,
    "asset_id long, channels long, bit_depth long, duration_ms long, rate long, n long, high long, left_sum long, right_sum long",
    f"""WITH w AS (SELECT asset_id, frame, CAST(floor(CAST(sample AS DOUBLE) * 32767 + 0.5e0) AS BIGINT) AS v, row_number() OVER (PARTITION BY asset_id ORDER BY frame) AS k, count(*) OVER (PARTITION BY asset_id) AS m FROM waves)
    SELECT asset_id, CAST(2 AS BIGINT) AS channels, CAST(16 AS BIGINT) AS bit_depth, count(*) * 1000 // {RATE} AS duration_ms, CAST({RATE} AS BIGINT) AS rate, count(*) AS n, max(v) AS high,
      CAST(sum(v * k) AS BIGINT) AS left_sum, CAST(sum(v * (m + 1 - k)) AS BIGINT) AS right_sum FROM w GROUP BY asset_id""",
)


def aiff_row(i: int, x: np.ndarray) -> list[tuple]:
    data = pcm_aiff(x)
    facts, (y, rate) = codecs.facts_of(data, "aiff"), codecs.decode(data, "aiff")
    return [(i, facts.duration_ms, facts.bit_depth, rate, len(y), float(y.min()), float(y.max()))]


add_kernel(
    "aiff_decode",
    aiff_row,
    "asset_id long, duration_ms long, bits long, sample_rate long, frames long, low double, high double",
    f"""WITH d AS (SELECT asset_id, floor(CAST(sample AS DOUBLE) * 32767 + 0.5e0) / 32768 AS y FROM waves)
    SELECT asset_id, count(*) * 1000 // {RATE} AS duration_ms, CAST(16 AS BIGINT) AS bits, CAST({RATE} AS BIGINT) AS sample_rate, count(*) AS frames, round(min(y), 4) AS low, round(max(y), 4) AS high FROM d GROUP BY asset_id""",
    "low",
    "high",
)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, path, content): every third file breaks off within its header."""
    rows = each(signals(spark, sf_dir), lambda i, x: [(i, f"/s/{i}.wav", float_bytes(x)[: 10 if i % 3 == 2 else None])], "asset_id long, path string, content binary")
    return rows


add(
    "decode_reports",
    lambda s, d: audio.decode_reports(contents(s, d)).drop("decode_ms"),
    f"""WITH g AS (SELECT asset_id, n, asset_id % 3 <> 2 AS good FROM sizes)
    SELECT '/s/' || asset_id || '.wav' AS path, CAST(CASE WHEN good THEN 3 END AS BIGINT) AS format, CAST(CASE WHEN good THEN 1 END AS BIGINT) AS channels, CAST(CASE WHEN good THEN {RATE} END AS BIGINT) AS sample_rate,
      CAST(CASE WHEN good THEN 32 END AS BIGINT) AS bits, CASE WHEN good THEN 4 * n END AS data_size, CASE WHEN good THEN n END AS frames, CASE WHEN NOT good THEN 'no decoder for this wav file' END AS error FROM g""",
)


def clip_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contents(spark, sf_dir).withColumn("start", F.col("asset_id") % 4 * 0.01).withColumn("end", F.col("start") + 0.03 + F.col("asset_id") % 5 * 0.02)
    return audio.clips(rows).select("path", "frames", "technique", F.length("wav").cast("long").alias("bytes"), "error")


add(
    "clip_export",
    clip_export,
    f"""WITH c AS (SELECT asset_id, n, asset_id % 4 * 0.01e0 AS a, asset_id % 4 * 0.01e0 + 0.03e0 + asset_id % 5 * 0.02e0 AS b FROM sizes),
    f AS (SELECT *, CASE WHEN asset_id % 3 = 2 THEN 'no decoder for this wav file' WHEN b - a < 0.05e0 THEN 'clip is too short or not finite' END AS error,
      least(CAST(ceil(b * {RATE}) AS BIGINT), n) - greatest(0, least(CAST(floor(a * {RATE}) AS BIGINT), n - 1)) AS k FROM c)
    SELECT '/s/' || asset_id || '.wav' AS path, CASE WHEN error IS NULL THEN k END AS frames, CASE WHEN error IS NULL THEN 'passthrough' END AS technique, CASE WHEN error IS NULL THEN 44 + 4 * k END AS bytes, error FROM f""",
)


def loop_points(i: int, x: np.ndarray) -> list[tuple]:
    data = wav.float_wav(x[:, None], RATE, (i % 9, len(x) - 1))
    at = data.index(b"smpl", 44 + 4 * len(x))
    size, *head = struct.unpack_from("<I9I", data, at + 4)
    _, kind, first, last, _, times = struct.unpack_from("<6I", data, at + 44)
    return [(i, len(data), size, head[2], head[3], head[7], kind, first, last, times)]


add_kernel(
    "wav_loop_points",
    loop_points,
    "asset_id long, bytes long, chunk long, period_ns long, note long, loops long, kind long, first long, last long, times long",
    f"""SELECT asset_id, 44 + 4 * n + 68 AS bytes, CAST(60 AS BIGINT) AS chunk, CAST({1_000_000_000 // RATE} AS BIGINT) AS period_ns, CAST(60 AS BIGINT) AS note, CAST(1 AS BIGINT) AS loops,
    CAST(0 AS BIGINT) AS kind, asset_id % 9 AS first, n - 1 AS last, CAST(0 AS BIGINT) AS times FROM sizes""",
)
add_kernel(
    "peaks_to_floats",
    lambda i, x: [(i, len(y := K.floats_of(x.astype("<f4").tobytes() + b"ab")), float(y.astype(np.float64).sum()))],
    "asset_id long, n long, total double",
    "SELECT asset_id, count(*) AS n, round(sum(CAST(sample AS DOUBLE)), 4) AS total FROM waves GROUP BY asset_id",
    "total",
)

# --- kernels of the post-process chain -------------------------------------------------

SPECTRUM_SQL = """w AS (SELECT asset_id, frame - 244 AS k, CAST(sample AS DOUBLE) * (0.5e0 - 0.5e0 * cos(2 * pi() * (frame - 244) / 511)) AS v FROM waves WHERE frame BETWEEN 244 AND 755),
    m AS (SELECT asset_id, bin, sqrt(pow(sum(v * cos(2 * pi() * k * bin / 512)), 2) + pow(sum(v * sin(2 * pi() * k * bin / 512)), 2)) AS mag FROM w, (SELECT unnest(range(0, 257)) AS bin) GROUP BY asset_id, bin)"""

add_kernel(
    "signal_spectrum",
    lambda i, x: [(i, k, float(v)) for k, v in enumerate(K.spectrum(x, 500))],
    "asset_id long, bin long, magnitude double",
    f"WITH {SPECTRUM_SQL} SELECT asset_id, bin, round(mag, 4) AS magnitude FROM m",
    "magnitude",
)
add_kernel(
    "signal_mfcc_like",
    lambda i, x: [(i, k, float(v)) for k, v in enumerate(K.mfcc_like(K.spectrum(x, 500)))],
    "asset_id long, band long, value double",
    f"WITH {SPECTRUM_SQL}, b AS (SELECT unnest(range(0, 13)) AS band) SELECT asset_id, band, round(ln(avg(mag) + 1e-10), 4) AS value FROM m JOIN b ON bin >= band * 257 // 13 AND bin < (band + 1) * 257 // 13 GROUP BY asset_id, band",
    "value",
)
add_kernel(
    "signal_chroma",
    lambda i, x: [(i, k, float(v)) for k, v in enumerate(K.chroma(K.spectrum(x, 500), RATE))],
    "asset_id long, pitch long, value double",
    f"""WITH {SPECTRUM_SQL}, p AS (SELECT asset_id, mag, log2(bin * {RATE} / 512e0) + 1000 AS o FROM m WHERE bin * {RATE} / 512e0 >= 20),
    q AS (SELECT asset_id, CAST(floor(12 * (o - 12 * floor(o / 12))) AS BIGINT) % 12 AS pitch, mag FROM p), a AS (SELECT asset_id, unnest(range(0, 12)) AS pitch FROM sizes)
    SELECT asset_id, pitch, round(coalesce(sum(mag), 0), 4) AS value FROM a LEFT JOIN q USING (asset_id, pitch) GROUP BY asset_id, pitch""",
    "value",
)



def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.signal_kinds(signals(spark, sf_dir).select("asset_id", F.lit(RATE).alias("sample_rate"), "samples"))
    return found.select("asset_id", F.round("correlation", 4).alias("correlation"), F.round("hz", 4).alias("hz"), F.col("kind").cast("long").alias("kind"))


add(
    "signal_kinds",
    kinds,
    f"""WITH h AS (SELECT asset_id, frame - 250 AS k, CAST(sample AS DOUBLE) AS s FROM waves WHERE frame BETWEEN 250 AND 749), l AS (SELECT unnest(range(4, 499)) AS lag),
    z AS (SELECT asset_id, sum(s * s) AS r0 FROM h GROUP BY asset_id),
    r AS (SELECT a.asset_id, lag, sum(a.s * b.s) / any_value(r0) AS r FROM h a JOIN z USING (asset_id), l, h b WHERE b.asset_id = a.asset_id AND b.k = a.k + lag GROUP BY a.asset_id, lag),
    best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY r DESC, lag) = 1)
    SELECT asset_id, round(r, 4) AS correlation, round({RATE} / lag, 4) AS hz, CAST(CASE WHEN r > 0.7 THEN 2 WHEN r > 0.4 THEN 1 ELSE 0 END AS BIGINT) AS kind FROM best""",
)


def loop_row(i: int, x: np.ndarray) -> list[tuple]:
    found = K.loop_candidate(x, RATE, RATE / (40 + i % 7), True)
    return [(i, found["start"], found["end"], float(found["correlation"]), float(found["amdf"]), float(found["zero_crossing"]), float(found["slope"]))]


add_kernel(
    "loop_candidate",
    loop_row,
    'asset_id long, start long, end long, correlation double, amdf double, zero_crossing double, slope double',
    """WITH z AS (SELECT asset_id, 40 + asset_id % 7 AS p, min(frame) AS start FROM (SELECT *, lag(sample) OVER (PARTITION BY asset_id ORDER BY frame) AS before FROM waves WHERE frame BETWEEN 100 AND 899) WHERE before < 0 AND sample >= 0 GROUP BY asset_id),
    r AS (SELECT asset_id, p, start, least(start + 8 * p, 900) AS last FROM z),
    h AS (SELECT r.asset_id, frame - start AS k, CAST(sample AS DOUBLE) AS a FROM waves JOIN r ON r.asset_id = waves.asset_id AND frame >= start AND frame < start + p),
    t AS (SELECT r.asset_id, frame - (last - p) AS k, CAST(sample AS DOUBLE) AS b FROM waves JOIN r ON r.asset_id = waves.asset_id AND frame >= last - p AND frame < last),
    c AS (SELECT asset_id, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS r, avg(abs(b - a)) / avg(abs(b)) AS d FROM h JOIN t USING (asset_id, k) GROUP BY asset_id)
    SELECT asset_id, start, last AS "end", round(c.r, 4) AS correlation, round(least(1, d), 4) AS amdf, CASE WHEN c.r > 0.5 THEN 0.8e0 ELSE 0.3e0 END AS zero_crossing, round(0.9e0 * c.r, 4) AS slope FROM r JOIN c USING (asset_id)""",
    "correlation",
    "amdf",
    "zero_crossing",
    "slope",
)


def fade_rows(i: int, x: np.ndarray) -> list[tuple]:
    n = 1 + i % 12
    return [(i, kind, k, float(a), float(b)) for kind in ("linear", "equal_power", "adaptive") for k, (a, b) in enumerate(zip(*K.fades(n, kind, 0.3)))]


add_kernel(
    "fade_gains",
    fade_rows,
    "asset_id long, kind string, k long, rising double, falling double",
    """WITH g AS (SELECT asset_id, 1 + asset_id % 12 AS n, unnest(range(0, 1 + asset_id % 12)) AS k FROM sizes),
    u AS (SELECT asset_id, n, k, k / (n - 1) AS t, (n - 1 - k) / (n - 1) AS s, kind FROM g, (SELECT unnest(['linear', 'equal_power', 'adaptive']) AS kind)),
    v AS (SELECT *, CASE WHEN n = 1 THEN 1 WHEN kind = 'linear' THEN t WHEN kind = 'equal_power' THEN sin(pi() / 2 * t) ELSE t / sqrt(2 * t * (0.3e0 + t - 1 - 0.3e0 * t) + 1) END AS a,
      CASE WHEN n = 1 THEN 0 WHEN kind = 'linear' THEN s WHEN kind = 'equal_power' THEN sin(pi() / 2 * s) ELSE s / sqrt(2 * s * (0.3e0 + s - 1 - 0.3e0 * s) + 1) END AS b FROM u)
    SELECT asset_id, kind, k, round(a, 4) AS rising, round(b, 4) AS falling FROM v""",
    "rising",
    "falling",
)


def frames_of(i: int, x: np.ndarray) -> list[tuple]:
    return [(i, k, float(v)) for k, v in enumerate(x.reshape(-1).astype(np.float64))]


OUT = "asset_id long, frame long, sample double"
add_kernel(
    "seam_blend",
    lambda i, x: frames_of(i, K.blend_seam(x[:, None].astype(np.float64), 50, "equal_power")),
    OUT,
    """SELECT a.asset_id, a.frame, round(CASE WHEN a.frame < 50 THEN b.sample * sin(pi() / 2 * (49 - a.frame) / 49) + a.sample * sin(pi() / 2 * a.frame / 49) ELSE a.sample END, 4) + 0e0 AS sample
    FROM waves a JOIN sizes USING (asset_id) LEFT JOIN waves b ON b.asset_id = a.asset_id AND b.frame = n - 50 + a.frame""",
    "sample",
)
add_kernel(
    "split_swap",
    lambda i, x: frames_of(i, K.split_swap(x[:, None], RATE, 0.05).samples),
    OUT,
    """WITH s AS (SELECT asset_id, n, n // 2 AS half, least(400, n // 2 - 1) AS xf FROM sizes),
    o AS (SELECT *, unnest(range(0, n - xf)) AS frame FROM s),
    p AS (SELECT *, frame - (n - half - xf) AS k FROM o)
    SELECT p.asset_id, p.frame, round(CASE WHEN k < 0 THEN b.sample WHEN k < xf THEN b.sample * sin(pi() / 2 * (xf - 1 - k) / (xf - 1)) + a.sample * sin(pi() / 2 * k / (xf - 1)) ELSE a.sample END, 4) + 0e0 AS sample
    FROM p LEFT JOIN waves b ON b.asset_id = p.asset_id AND k < xf AND b.frame = half + p.frame LEFT JOIN waves a ON a.asset_id = p.asset_id AND k >= 0 AND a.frame = k""",
    "sample",
)


def aligned_row(i: int, x: np.ndarray) -> list[tuple]:
    y = K.align_seam(x[INNER, None], 20)[:, 0]
    return [(i, len(y), float(y[0]), float(y[-1]))]


add_kernel(
    "seam_alignment",
    aligned_row,
    "asset_id long, frames long, first double, last double",
    """WITH x AS (SELECT asset_id, frame - 30 AS f, CAST(sample AS DOUBLE) AS s FROM waves WHERE frame >= 30 AND frame < 970),
    g AS (SELECT unnest(range(0, 21)) AS c), w AS (SELECT unnest(range(0, 48)) AS k),
    h AS (SELECT asset_id, c AS a, k, s FROM x, g, w WHERE f = c + k), t AS (SELECT asset_id, c AS b, k, s FROM x, g, w WHERE f = 940 - c - 48 + k),
    e AS (SELECT h.asset_id, a, b, sum(pow(t.s - h.s, 2)) AS e FROM h JOIN t USING (asset_id, k) GROUP BY ALL),
    r AS (SELECT e.asset_id, e.a, e.b, e + 48 * pow(l.s - f.s, 2) AS err FROM e JOIN x f ON f.asset_id = e.asset_id AND f.f = e.a JOIN x l ON l.asset_id = e.asset_id AND l.f = 939 - e.b),
    best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY err, a, b) = 1)
    SELECT best.asset_id, 940 - a - b AS frames, round(f.s, 4) AS first, round(l.s, 4) AS last FROM best JOIN x f ON f.asset_id = best.asset_id AND f.f = a JOIN x l ON l.asset_id = best.asset_id AND l.f = 939 - b""",
    "first",
    "last",
)
add_kernel(
    "welded_ends",
    lambda i, x: frames_of(i, K.weld_ends(x[INNER, None].astype(np.float64))),
    OUT,
    """SELECT a.asset_id, a.frame - 30 AS frame, round(CASE WHEN a.frame = 969 THEN b.sample WHEN a.frame >= 938 THEN a.sample * (1 - (a.frame - 937) / 32) + b.sample * ((a.frame - 937) / 32) ELSE a.sample END, 4) + 0e0 AS sample
    FROM waves a JOIN waves b ON b.asset_id = a.asset_id AND b.frame = 30 WHERE a.frame >= 30 AND a.frame < 970""",
    "sample",
)


def rule_row(i: int, x: np.ndarray) -> list[tuple]:
    frames, seconds = 3 + i * 37 % 900, None if i % 4 == 0 else i % 7 * 0.01
    return [(i, K.longest_crossfade(frames), K.crossfade_frames(seconds, RATE, frames), float(K.split_swap_seconds(seconds, frames, RATE)))]


add_kernel(
    "crossfade_rules",
    rule_row,
    "asset_id long, longest long, frames long, seconds double",
    f"""WITH r AS (SELECT asset_id, 3 + asset_id * 37 % 900 AS n, CASE WHEN asset_id % 4 <> 0 THEN asset_id % 7 * 0.01e0 END AS s FROM sizes),
    c AS (SELECT *, CASE WHEN n < 4 THEN 0 ELSE n // 2 - 1 END AS cap FROM r),
    m AS (SELECT *, CASE WHEN cap > 0 THEN greatest(cap / {RATE}, 0.05e0) ELSE 0.05e0 END AS most FROM c)
    SELECT asset_id, cap AS longest, CASE WHEN cap = 0 THEN 0 ELSE greatest(least(CASE WHEN cap >= 8 THEN 8 ELSE 2 END, cap), CASE WHEN s IS NULL THEN cap ELSE least(CAST(floor(s * {RATE} + 0.5e0) AS BIGINT), cap) END) END AS frames,
      round(CASE WHEN s IS NULL THEN most ELSE greatest(0.05e0, least(greatest(0.5e0, least(3e0, s)), most)) END, 4) AS seconds FROM m""",
    "seconds",
)


def processed_row(i: int, x: np.ndarray) -> list[tuple]:
    found = K.post_process(x[:, None], RATE, K.PostProcess(trim_silence=True, trim_threshold_db=-20.0, trim_min_silence_ms=1.0, trim_peak_window_ms=4.0, normalize_peak=True, normalize_target=0.25))
    return [(i, found.technique, len(found.samples), found.loop_end, float(np.abs(found.samples).max()), float(found.samples[0, 0]))]


add_kernel(
    "post_process",
    processed_row,
    "asset_id long, technique string, frames long, loop_end long, peak double, first double",
    """WITH p AS (SELECT asset_id, frame, max(abs(sample)) OVER (PARTITION BY asset_id ORDER BY frame ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS level FROM waves),
    g AS (SELECT asset_id, min(frame) FILTER (level >= 0.1e0) AS a, max(frame) FILTER (level >= 0.1e0) AS b, count(*) AS n FROM p GROUP BY asset_id),
    k AS (SELECT asset_id, CASE WHEN a >= 8 THEN a ELSE 0 END AS a, CASE WHEN n - b - 1 >= 8 THEN b + 1 ELSE n END AS b FROM g),
    m AS (SELECT k.asset_id, k.a, k.b, max(abs(sample)) AS top, arg_min(sample, frame) AS s FROM k JOIN waves ON waves.asset_id = k.asset_id AND frame >= k.a AND frame < k.b GROUP BY ALL)
    SELECT asset_id, 'passthrough' AS technique, b - a AS frames, b - a - 1 AS loop_end, 0.25e0 AS peak, round(s * (0.25e0 / top), 4) AS first FROM m""",
    "peak",
    "first",
)


def looped_row(i: int, x: np.ndarray) -> list[tuple]:
    found = K.post_process(x[:, None], RATE, K.PostProcess(make_loopable=True))
    y = found.samples[:, 0]
    return [(i, found.technique != "passthrough", found.loop_start, found.loop_end == len(y) - 1, float(abs(y[-1] - y[0])), len(y) > len(x) // 3)]


add_kernel(
    "looped_clips",
    looped_row,
    "asset_id long, looped boolean, loop_start long, whole boolean, click double, long_enough boolean",
    "SELECT asset_id, true AS looped, CAST(0 AS BIGINT) AS loop_start, true AS whole, 0e0 AS click, true AS long_enough FROM sizes",
    "click",
)

# --- numbers for clips and lists ---------------------------------------------------------

PICK = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int"))
add(
    "trim_presets",
    lambda s, d: assets(s, d).select("id", N.trim_preset(PICK((-60.0, -48.0, -72.0, -60.0)), PICK((15.0, 5.0, 40.0, 15.0, 15.0)), PICK((4.0, 3.0, 6.0, 4.005))).alias("preset")),
    """WITH p AS (SELECT id, [-60, -48, -72, -60][id % 4 + 1] AS t, [15, 5, 40, 15, 15][id % 5 + 1] AS m, [4, 3, 6, 4.005][id % 4 + 1] AS w FROM assets)
    SELECT id, CASE WHEN t = -60 AND m = 15 AND abs(w - 4) < 0.01 THEN 'balanced' WHEN t = -48 AND m = 5 AND w = 3 THEN 'tight' WHEN t = -72 AND m = 40 AND w = 6 THEN 'loose' ELSE 'custom' END AS preset FROM p""",
    ASSETS_SQL,
)
add(
    "visible_rows",
    lambda s, d: assets(s, d).select("id", N.visible_rows(F.col("id") * 37, F.lit(600), F.lit(48), F.lit(1000)).alias("v")).select("id", "v.start", "v.end", "v.offset", "v.height"),
    """WITH f AS (SELECT id, greatest(0, CAST(floor(id * 37 / 48) AS BIGINT) - 5) AS a FROM assets)
    SELECT id, a AS start, least(1000, a + 13 + 10) AS "end", a * 48 AS "offset", CAST(48000 AS INTEGER) AS height FROM f""",
    ASSETS_SQL,
)
add(
    "clip_nudges",
    lambda s, d: assets(s, d).select("id", N.nudged_clip(F.col("id") % 10 * 0.5, F.col("id") % 10 * 0.5 + 0.3, PICK(("start", "end")), F.col("id") % 700 * 3, PICK((1, 1, -1)), F.lit(4.5)).alias("c")).select("id", F.round("c.start", 6).alias("start"), F.round("c.end", 6).alias("end")),
    """WITH p AS (SELECT id, id % 10 * 0.5e0 AS s, id % 10 * 0.5e0 + 0.3e0 AS e, id % 2 = 0 AS first, greatest(10e0, least(10000e0, id % 700 * 3)) / 1000 * [1, 1, -1][id % 3 + 1] AS step FROM assets),
    m AS (SELECT id, s, e, greatest(0, least(CASE WHEN first THEN s + step ELSE s END, 4.5e0)) AS a, greatest(0, least(CASE WHEN first THEN e ELSE e + step END, 4.5e0)) AS b FROM p)
    SELECT id, round(CASE WHEN abs(b - a) >= 0.05e0 THEN least(a, b) ELSE s END, 6) AS start, round(CASE WHEN abs(b - a) >= 0.05e0 THEN greatest(a, b) ELSE e END, 6) AS "end" FROM m""",
    ASSETS_SQL,
)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = signals(spark, sf_dir).select("asset_id", F.transform("samples", lambda v: N.envelope(v, -v / 2)).alias("levels"))
    return x.select("asset_id", F.round(N.envelope_at(F.col("levels"), F.lit(0.37)), 4).alias("level"))


add(
    "peak_envelope",
    envelopes,
    """WITH e AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY frame) - 1 AS k, 0.37e0 * (count(*) OVER (PARTITION BY asset_id) - 1) AS at, count(*) OVER (PARTITION BY asset_id) AS n, least(1, abs(CAST(sample AS DOUBLE))) AS v FROM waves)
    SELECT a.asset_id, round(a.v + (b.v - a.v) * (a.at - a.k), 4) AS level FROM e a JOIN e b ON a.asset_id = b.asset_id AND a.k = CAST(floor(a.at) AS BIGINT) AND b.k = least(a.k + 1, a.n - 1)""",
)

# --- files, ingest, snapshots, settings ------------------------------------------------------


def library(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a WAVE (even blocks) or AIFF file of each block; the first of every ten is broken."""
    folder = scratch_folder(spark, "library")

    def one(i: int, x: np.ndarray) -> list[tuple]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        place = f"{base}/Maker {i % 2}/Kind {i % 3}"
        store.create_dir(place, recursive=True)
        data = b"broken" if i % 10 == 0 else pcm_aiff(x) if i % 2 else pcm_wav(x, 16)
        with store.open_output_stream(f"{place}/block {i}.{'aiff' if i % 2 else 'WAV'}", compression=None) as out:
            out.write(data)
        return [(i,)]

    each(signals(spark, sf_dir), one, "asset_id long").write.format("noop").mode("overwrite").save()
    return folder


def grown(spark: SparkSession, sf_dir: str, progress=lambda phase, n: None):
    """An empty catalog but for one file that is gone, brought up to date with the folder."""
    folder = library(spark, sf_dir)
    place = folder.removeprefix("file://")
    old = assets(spark, sf_dir).where("id = 5").withColumn("path", F.lit(f"{place}/gone.wav"))
    none = writes.wiped(catalog(spark, sf_dir))
    return ingest(Catalog(old, none.tags, none.asset_tags, none.embeddings, spark.createDataFrame([(5, [0.5])], PEAKS)), folder, resolution=4, now=1_700_000_000, progress=progress), folder


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grown(spark, sf_dir)[0].catalog
    peaks = found.peaks.select("asset_id", F.round(F.array_max("peaks"), 4).alias("high"), F.size("peaks").alias("n_peaks"))
    rows = found.assets.join(peaks, F.col("id") == F.col("asset_id"), "left")
    return rows.select("filename", "extension", "publisher", "category", "duration_ms", "sample_rate", "channels", "bit_depth", "file_size", "indexed_at", "favorite", "n_peaks", F.round(F.col("high").cast("double"), 3).alias("high"))


GOOD = "SELECT * FROM sizes WHERE asset_id % 10 <> 0"
add(
    "ingest_assets",
    ingested,
    f"""WITH g AS ({GOOD}), p AS (SELECT asset_id, max(floor(CAST(sample AS DOUBLE) * 32767 + 0.5e0) / 32768) AS high FROM waves GROUP BY asset_id)
    SELECT 'block ' || asset_id AS filename, CASE WHEN asset_id % 2 = 1 THEN 'aiff' ELSE 'wav' END AS extension, 'Maker ' || asset_id % 2 AS publisher, 'Kind ' || asset_id % 3 AS category, n * 1000 // {RATE} AS duration_ms, CAST({RATE} AS INTEGER) AS sample_rate, CAST(1 AS INTEGER) AS channels,
      CAST(16 AS INTEGER) AS bit_depth, CASE WHEN asset_id % 2 = 1 THEN 54 ELSE 44 END + 2 * n AS file_size, CAST(1700000000 AS BIGINT) AS indexed_at, false AS favorite, CAST(8 AS INTEGER) AS n_peaks, round(high, 3) AS high FROM g JOIN p USING (asset_id)""",
)


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = library(spark, sf_dir)
    return files.list_tree(spark, folder).select(F.substring_index("path", "/", -3).alias("path"), "extension", "file_size")


add(
    "library_listing",
    listed,
    """SELECT 'Maker ' || asset_id % 2 || '/Kind ' || asset_id % 3 || '/block ' || asset_id || CASE WHEN asset_id % 2 = 1 THEN '.aiff' ELSE '.WAV' END AS path, CASE WHEN asset_id % 2 = 1 THEN 'aiff' ELSE 'wav' END AS extension,
      CASE WHEN asset_id % 10 = 0 THEN 6 ELSE CASE WHEN asset_id % 2 = 1 THEN 54 ELSE 44 END + 2 * n END AS file_size FROM sizes""",
)


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder with a hidden folder, a hidden file and names that begin with _, listed with and without hidden entries."""
    folder = library(spark, sf_dir)

    def more(i: int, x: np.ndarray) -> list[tuple]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        place = f"{base}/Maker {i % 2}/{('.cache', '_odd', 'plain')[i % 3]}"
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/{('', '_', '.')[i % 3]}take {i}.flac", compression=None) as out:
            out.write(bytes(i % 7))
        return [(i,)]

    each(signals(spark, sf_dir), more, "asset_id long").write.format("noop").mode("overwrite").save()
    shown, every = files.walk(spark, folder), files.walk(spark, folder, skip_hidden=False)
    rows = every.join(shown.select("path", F.lit(True).alias("shown")), "path", "left")
    return rows.select(F.substring_index("path", "/", -2).alias("path"), "extension", "file_size", F.coalesce("shown", F.lit(False)).alias("shown"), F.col("error").isNotNull().alias("failed"))


add(
    "library_walk",
    walked,
    """SELECT 'Kind ' || asset_id % 3 || '/block ' || asset_id || CASE WHEN asset_id % 2 = 1 THEN '.aiff' ELSE '.WAV' END AS path, CASE WHEN asset_id % 2 = 1 THEN 'aiff' ELSE 'wav' END AS extension,
      CASE WHEN asset_id % 10 = 0 THEN 6 ELSE CASE WHEN asset_id % 2 = 1 THEN 54 ELSE 44 END + 2 * n END AS file_size, true AS shown, false AS failed FROM sizes
    UNION ALL SELECT ['.cache', '_odd', 'plain'][asset_id % 3 + 1] || '/' || ['', '_', '.'][asset_id % 3 + 1] || 'take ' || asset_id || '.flac', 'flac', asset_id % 7, asset_id % 3 = 1, false FROM sizes""",
)


def rescanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roots after a first scan: the same folder, where only broken files are tried again, and one that is not there."""
    first, folder = grown(spark, sf_dir)
    found = ingest_roots(first.catalog, [folder, f"{folder}-none"], resolution=4, now=1)
    name = F.when(F.col("root").endswith("-none"), "none").when(F.col("root").isNotNull(), "library")
    return found.stats.select(name.alias("root"), "indexed", "skipped", "missing", "errors")


add(
    "ingest_stats",
    rescanned,
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (asset_id % 10 = 0) AS bad FROM sizes)
    SELECT 'library' AS root, CAST(0 AS BIGINT) AS indexed, n - bad AS skipped, CAST(0 AS BIGINT) AS missing, bad AS errors FROM c UNION ALL SELECT 'none', 0, 0, 0, 1 UNION ALL SELECT NULL, 0, n - bad, 0, bad + 1 FROM c""",
)


def progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told: list[tuple[str, int]] = []
    grown(spark, sf_dir, lambda phase, n: told.append((phase, n)))
    return spark.createDataFrame([(at, *t) for at, t in enumerate(told)], "nth int, phase string, n long")


add("ingest_progress", progress_rows, "SELECT CAST(i AS INTEGER) AS nth, ['enumerating', 'indexing', 'complete'][i + 1] AS phase, (SELECT count(*) FROM sizes) AS n FROM range(3) r(i)")


def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported, wiped, imported again: rows of each table in each snapshot."""
    folder, full = scratch_folder(spark, "snapshots"), catalog(spark, sf_dir)
    snapshots.export_catalog(full, f"{folder}/export")
    snapshots.write_snapshot(writes.wiped(full), f"{folder}/own")
    wiped = snapshots.read_snapshot(spark, f"{folder}/own")
    snapshots.import_catalog(spark, f"{folder}/export", f"{folder}/own")
    now = snapshots.read_snapshot(spark, f"{folder}/own")
    rows = None
    for state, own in (("wiped", wiped), ("imported", now)):
        for name in snapshots.TABLES[:4]:
            one = getattr(own, name).agg(F.count("*").alias("n")).select(F.lit(state).alias("state"), F.lit(name).alias("name"), "n")
            rows = one if rows is None else rows.unionByName(one)
    return rows


add(
    "snapshot_counts",
    snapshot_counts,
    """SELECT state, name, CASE WHEN state = 'wiped' THEN 0 ELSE n END AS n FROM (SELECT unnest(['wiped', 'imported']) AS state), (SELECT 'assets' AS name, count(*) AS n FROM documents UNION ALL SELECT 'tags', 4
    UNION ALL SELECT 'asset_tags', count(*) + count(*) FILTER (toxic = 1) FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels) UNION ALL SELECT 'embeddings', count(*) FROM embeddings)""",
    "",
)


def stored_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = signals(spark, sf_dir).select("asset_id", F.array_sort("samples").alias("peaks"))
    new = old.where("asset_id % 2 = 0").withColumn("peaks", F.array(F.lit(0.25).cast("float")))
    return writes.update_peaks(old, new).select("asset_id", F.size("peaks").alias("n"), F.round(F.element_at("peaks", -1).cast("double"), 4).alias("last"))


add("peaks_update", stored_peaks, "SELECT asset_id, CAST(CASE WHEN asset_id % 2 = 0 THEN 1 ELSE count(*) END AS INTEGER) AS n, round(CASE WHEN asset_id % 2 = 0 THEN 0.25e0 ELSE CAST(max(sample) AS DOUBLE) END, 4) AS last FROM waves GROUP BY asset_id")

# --- streams ----------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(spark: SparkSession, rows: DataFrame, mode: str) -> DataFrame:
    """A stream's result, run until nothing new is there; the last batch's table is the result."""
    folder = scratch_folder(spark, "stream")
    writer = rows.writeStream.outputMode(mode).foreachBatch(lambda batch, nth: batch.write.mode("overwrite").parquet(f"{folder}/result"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/result")


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = event_stream(spark, sf_dir).select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("frame"), (F.col("value") / 100 - 0.5).alias("sample"))
    return drained(spark, watch.chunked(x, 100, 5.0), "complete").select("asset_id", "chunk", "first_frame", "n_frames", F.round("peak", 6).alias("peak"))


add("stream_chunks", stream_chunks, "SELECT user_id AS asset_id, event_id // 500 AS chunk, min(event_id) AS first_frame, count(*) AS n_frames, round(max(abs(value / 100 - 0.5e0)), 6) AS peak FROM events GROUP BY ALL", "")
add(
    "stream_event_windows",
    lambda s, d: drained(s, watch.event_counts(event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 3).alias("total")),
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "",
)


def watch_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    told: list[int] = []
    folder = library(spark, sf_dir)
    watch.watch(spark, folder, f"{scratch_folder(spark, 'watch')}", told.append, available_now=True).awaitTermination()
    return spark.createDataFrame([(sum(told), bool(told))], "files long, changed boolean")


add("watch_news", watch_news, "SELECT count(*) AS files, true AS changed FROM sizes")


def writers_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers start from one snapshot; one is refused and works again on what the other wrote. Facts of every version."""
    base, full = scratch_folder(spark, "race"), catalog(spark, sf_dir)
    snapshots.commit(full, base, 0)
    first, second = snapshots.read_version(spark, base), snapshots.read_version(spark, base)
    change = lambda own, rest: writes.set_favorite(own.catalog.assets, own.catalog.assets.where(F.col("id") % 4 == rest).select("id"), True)
    snapshots.commit(replace(first.catalog, assets=change(first, 1)), base, first.version)
    refused = False
    try:
        snapshots.commit(replace(second.catalog, assets=change(second, 2)), base, second.version)
    except snapshots.Conflict:
        refused = True
        second = snapshots.read_version(spark, base)
        snapshots.commit(replace(second.catalog, assets=change(second, 2)), base, second.version)
    rows = None
    for v in (1, 2, 3):
        one = snapshots.read_version(spark, base, v).catalog.assets.agg(F.count("*").alias("n_assets"), F.count_if("favorite").alias("n_favorites")).select(F.lit(v).alias("version"), F.lit(refused).alias("refused"), "n_assets", "n_favorites")
        rows = one if rows is None else rows.unionByName(one)
    return rows


add(
    "writers_race",
    writers_race,
    """SELECT CAST(v AS INTEGER) AS version, true AS refused, count(*) AS n_assets, count(*) FILTER (doc_id % 10 = 0 OR (v > 1 AND doc_id % 4 = 1) OR (v > 2 AND doc_id % 4 = 2)) AS n_favorites FROM documents, range(1, 4) r(v) GROUP BY v""",
    "",
)


def cancelled_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingest that is cancelled while files are opened; then the same one again. The catalog's assets after each."""
    folder, none = library(spark, sf_dir), writes.wiped(catalog(spark, sf_dir))
    start = replace(none, assets=assets(spark, sf_dir).where("id < 3"))
    marker = control.Marker(f"{scratch_folder(spark, 'marker')}/stop")
    kept, state = start, "finished"
    try:
        # Told before files are opened, so tasks find the marker.
        kept = ingest(start, folder, now=1, resolution=4, cancel=marker, progress=lambda phase, n: marker.set() if phase == "indexing" else None).catalog
    except control.Cancelled:
        state = "cancelled"
    after = ingest(start, folder, now=1, resolution=4).catalog
    count = lambda own, name: own.assets.agg(F.lit(name).alias("state"), F.count("*").alias("n_assets"))
    return count(kept, state).unionByName(count(after, "finished"))


add("ingest_cancelled", cancelled_ingest, f"SELECT 'cancelled' AS state, (SELECT count(*) FROM documents WHERE doc_id < 3) AS n_assets UNION ALL SELECT 'finished', (SELECT count(*) FROM documents WHERE doc_id < 3) + (SELECT count(*) FROM ({GOOD}))")
