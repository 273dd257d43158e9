"""Numeric expressions: vectors, levels, clips, list windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest clip in seconds.
CLIP_MIN_SEC = 0.05
#: Peak levels on offer, in dBFS.
PEAK_LEVELS = (-12, -6, -3, -1, 0)
#: Named trim settings (threshold dB, shortest silence ms, peak window ms).
TRIM_PRESETS = {"balanced": (-60.0, 15.0, 4.0), "tight": (-48.0, 5.0, 3.0), "loose": (-72.0, 40.0, 6.0)}


def dot(a: Column, b: Column) -> Column:
    """Scalar product over the shorter vector's length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """The vector at unit length; shorter than 1e-8 stays as it is."""
    norm = l2_norm(a)
    return F.transform(a, lambda x: F.when(norm > 1e-8, x.cast("double") / norm).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """dot(normalized(a), normalized(b)), with one pass for each."""
    unit = lambda n: F.when(n > 1e-8, n).otherwise(F.lit(1.0))
    return dot(a, b) / (unit(l2_norm(a)) * unit(l2_norm(b)))


def unit_interval(similarity: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (similarity + 1) / 2))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(level: Column) -> Column:
    finite = ~F.isnan(level) & (level != float("inf"))
    return F.when((level > 0) & finite, 20 * F.log10(level)).otherwise(F.lit(-96.0))


def nearest_peak_level(level: Column) -> Column:
    """The offered level nearest to a linear peak; of two, the lower."""
    best, apart = F.lit(PEAK_LEVELS[0]), F.abs(level - 10 ** (PEAK_LEVELS[0] / 20))
    for db in PEAK_LEVELS[1:]:
        d = F.abs(level - 10 ** (db / 20))
        best, apart = F.when(d < apart, F.lit(db)).otherwise(best), F.least(d, apart)
    return best


def trim_preset(threshold_db: Column, min_silence_ms: Column, window_ms: Column) -> Column:
    name = F.lit("custom")
    for preset, values in reversed(TRIM_PRESETS.items()):
        near = [F.abs(c - v) < 0.01 for c, v in zip((threshold_db, min_silence_ms, window_ms), values)]
        name = F.when(near[0] & near[1] & near[2], F.lit(preset)).otherwise(name)
    return name


def clip_frames(start: Column, end: Column, rate: Column, frames: Column) -> Column:
    """struct(first, last_exclusive, error): the clip's frames within a file of so many; error is null if it is valid."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    first = F.greatest(F.lit(0), F.least(F.floor(start * rate), frames - 1))
    last = F.greatest(F.lit(1), F.least(F.ceil(end * rate), frames))
    last = F.least(F.when(last <= first, first + 1).otherwise(last), frames)
    error = (
        F.when(~(finite(start) & finite(end)), F.lit("clip times must be finite"))
        .when(end <= start, F.lit("clip end must be after start"))
        .when(end - start < CLIP_MIN_SEC, F.lit("clip is too short"))
        .when(frames <= 0, F.lit("no audio samples"))
        .when((last - first) / rate < CLIP_MIN_SEC - 1e-6, F.lit("clip is too short within the file"))
    )
    value = lambda c: F.when(error.isNull(), c.cast("long"))
    return F.struct(value(first).alias("first"), value(last).alias("last_exclusive"), error.alias("error"))


def clamped_clip(start: Column, end: Column, duration: Column) -> Column:
    """struct(start, end) within the duration, null if less than the shortest clip is left."""
    e = F.least(end, duration)
    s = F.least(start, e - CLIP_MIN_SEC)
    return F.when((duration > 0) & (e - s >= CLIP_MIN_SEC), F.struct(F.greatest(F.lit(0.0), s).alias("start"), e.alias("end")))


def defer_clamp(clip_end: Column, buffer_sec: Column, full_sec: Column) -> Column:
    return (full_sec > 0) & (buffer_sec > 0) & (buffer_sec < full_sec - 0.05) & (clip_end > buffer_sec + 1e-3)


def nudged_clip(start: Column, end: Column, edge: Column, step_ms: Column, direction: Column, duration: Column) -> Column:
    """struct(start, end) after moving the edge ('start' or 'end') by a step of 10 to 10,000 ms; edges swap if they cross."""
    step = F.greatest(F.lit(10.0), F.least(F.lit(10_000.0), step_ms.cast("double"))) / 1000 * direction
    within = lambda c: F.greatest(F.lit(0.0), F.least(c, duration))
    s = within(F.when(edge == "start", start + step).otherwise(start))
    e = within(F.when(edge == "end", end + step).otherwise(end))
    low, high = F.least(s, e), F.greatest(s, e)
    return F.when(high - low >= CLIP_MIN_SEC, F.struct(low.alias("start"), high.alias("end"))).otherwise(F.struct(start.alias("start"), end.alias("end")))


def visible_rows(scroll_top: Column, height: Column, row_height: Column, total: Column, extra: int = 5) -> Column:
    first = F.greatest(F.lit(0), F.floor(scroll_top / row_height) - extra)
    last = F.least(total, first + F.ceil(height / row_height) + 2 * extra)
    return F.struct(first.alias("start"), last.alias("end"), (first * row_height).alias("offset"), (total * row_height).alias("height"))


def envelope(low: Column, high: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.abs(low), F.abs(high)).cast("double"))


def envelope_at(levels: Column, position: Column) -> Column:
    """Linear interpolation of an array of levels at a fraction 0 to 1 of its length."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position)) * (F.size(levels) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.size(levels) - 1)
    return F.when(F.size(levels) > 0, F.get(levels, low) + (F.get(levels, high) - F.get(levels, low)) * (at - low))
