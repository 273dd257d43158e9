"""Signal operators as windows and aggregates over long rows (asset_id, frame, sample[, channel]).

Windows run by asset and block of frames, so neither many signals nor one very
long one end in a single task.
The Arrow kernels in functions.kernels do the same for arrays in one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

F32_EPS = 1.1920929e-7


#: Frames of a signal that one window partition holds, without its margins.
BLOCK_FRAMES = 262_144


def beside(samples: DataFrame, value: Callable[[WindowSpec], Column], name: str, before: int, after: int) -> DataFrame:
    """Adds a window expression that looks at most so many frames back and ahead; frames count up by 1.

    Windows run over blocks of frames, so a long signal is many tasks' work. A
    frame goes to its own block and, near an edge, to those that look at it.
    """
    block = max(BLOCK_FRAMES, before, after)
    number = lambda frame: F.floor(frame / block).cast("long")
    blocks = F.sequence(F.greatest(F.lit(0), number(F.col("frame") - after)), number(F.col("frame") + before))
    spread = samples.withColumn("_block", F.explode(blocks))
    found = spread.withColumn(name, value(Window.partitionBy("asset_id", "_block").orderBy("frame")))
    return found.where(F.col("_block") == number(F.col("frame"))).drop("_block")


def mono(samples: DataFrame) -> DataFrame:
    """Mean over the channels of each frame."""
    return samples.groupBy("asset_id", "frame").agg(F.avg("sample").alias("sample"))


def peaks(samples: DataFrame, resolution: int) -> DataFrame:
    """(asset_id, bucket, low, high): exactly resolution buckets, the last one takes the rest, missing ones are 0."""
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    sizes = samples.groupBy("asset_id").agg(F.count("*").alias("n")).withColumn("chunk", F.greatest(F.lit(1), F.floor(F.col("n") / resolution)))
    bucket = F.least(F.floor(F.col("frame") / F.col("chunk")), F.lit(resolution - 1)).cast("int")
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sample")))
    found = samples.join(sizes, "asset_id").groupBy("asset_id", bucket.alias("bucket")).agg(F.min(clamped).alias("low"), F.max(clamped).alias("high"))
    all_buckets = sizes.select("asset_id", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))).alias("bucket"))
    return all_buckets.join(found, ["asset_id", "bucket"], "left").fillna(0.0, ["low", "high"])


def levels(samples: DataFrame) -> DataFrame:
    """Peak and root mean square."""
    return samples.groupBy("asset_id").agg(F.max(F.abs("sample")).alias("peak"), F.sqrt(F.avg(F.col("sample") * F.col("sample"))).alias("rms"))


def normalized(samples: DataFrame, target: float) -> DataFrame:
    """Scaled so that the peak is target; near-silent signals and targets that are not positive change nothing."""
    if not (target > 0 and math.isfinite(target)):
        return samples
    # Summed by asset first: a long signal is a skewed join key, which Spark splits, not one window.
    peaks_of = samples.groupBy(F.col("asset_id").alias("_of")).agg(F.max(F.abs("sample")).alias("_peak"))
    joined = samples.join(peaks_of, F.col("asset_id").eqNullSafe(F.col("_of")))
    scaled = F.when(F.col("_peak") > F32_EPS, F.col("sample") * (target / F.col("_peak"))).otherwise(F.col("sample"))
    return joined.select(*[scaled.alias(c) if c == "sample" else F.col(c) for c in samples.columns])


def _half_window(window_ms: float, rate: int) -> int:
    return max(1, math.ceil(min(32.0, max(1.0, window_ms)) * 0.0005 * rate))


def silence_bounds(samples: DataFrame, rate: int, threshold_db: float, min_silence_ms: float, window_ms: float) -> DataFrame:
    """(asset_id, first, last_exclusive): what is left without silent edges; silent signals get (0, 0)."""
    half = _half_window(window_ms, rate)
    run = math.ceil(max(0.0, min_silence_ms) * 0.001 * rate)
    level = beside(samples, lambda w: F.max(F.abs(F.col("sample"))).over(w.rowsBetween(-half, half)), "level", half, half)
    loud = F.when(F.col("level") >= 10 ** (threshold_db / 20), F.col("frame"))
    found = level.groupBy("asset_id").agg(F.min(loud).alias("a"), F.max(loud).alias("b"), F.count("*").alias("n"))
    first = F.when(F.col("a").isNull(), 0).when(F.col("a") >= run, F.col("a")).otherwise(0)
    last = F.when(F.col("a").isNull(), 0).when(F.col("n") - F.col("b") - 1 >= run, F.col("b") + 1).otherwise(F.col("n"))
    return found.select("asset_id", first.cast("long").alias("first"), last.cast("long").alias("last_exclusive"))


def trimmed(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """Frames within the bounds, numbered from 0; an empty range leaves the signal as it is."""
    kept = samples.join(bounds, "asset_id").where((F.col("last_exclusive") <= F.col("first")) | F.col("frame").between(F.col("first"), F.col("last_exclusive") - 1))
    start = F.when(F.col("last_exclusive") > F.col("first"), F.col("first")).otherwise(0)
    return kept.withColumn("frame", F.col("frame") - start).drop("first", "last_exclusive")


def zero_crossings(samples: DataFrame) -> DataFrame:
    """Frames at which the signal turns from negative to not negative."""
    before = beside(samples, lambda w: F.lag("sample", 1).over(w), "before", 1, 0)
    return before.where("before < 0 AND sample >= 0").select("asset_id", "frame")


def lagged(samples: DataFrame, lag: int, pair: Column, name: str) -> DataFrame:
    """Mean of an expression of ``sample`` and ``later``, the sample lag frames on."""
    later = beside(samples, lambda w: F.lead("sample", lag).over(w), "later", 0, lag)
    return later.where("later IS NOT NULL").groupBy("asset_id").agg(F.avg(pair).alias(name))


def amdf(samples: DataFrame, lag: int) -> DataFrame:
    return lagged(samples, lag, F.abs(F.col("sample") - F.col("later")), "amdf")


def autocorrelation(samples: DataFrame, lag: int, block: int | None = None) -> DataFrame:
    """One lag, or all lags up to it over blocks of so many frames: autocorrelation_at, autocorrelation_sums."""
    return autocorrelation_at(samples, lag) if block is None else autocorrelation_sums(samples, lag, block)


def autocorrelation_at(samples: DataFrame, lag: int) -> DataFrame:
    """(asset_id, autocorrelation): r[lag] / r[0]; null for a silent signal."""
    later = beside(samples, lambda w: F.lead("sample", lag).over(w), "later", 0, lag)
    sums = later.groupBy("asset_id").agg(F.sum(F.col("sample") * F.coalesce("later", F.lit(0.0))).alias("r"), F.sum(F.col("sample") * F.col("sample")).alias("r0"))
    return sums.select("asset_id", F.when(F.col("r0") > 0, F.col("r") / F.col("r0")).alias("autocorrelation"))


def cross_correlation(pairs: DataFrame) -> DataFrame:
    """pairs (asset_id, a, b): normalised correlation between -1 and 1."""
    sums = pairs.groupBy("asset_id").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    r = F.col("ab") / F.greatest(F.sqrt("aa") * F.sqrt("bb"), F.lit(F32_EPS))
    return sums.select("asset_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("correlation"))


def chunks(samples: DataFrame, rate: int, seconds: float = 2.0) -> DataFrame:
    """(asset_id, chunk, first_frame, n_frames, peak) of fixed-size chunks; the last may be shorter."""
    size = max(1, int(rate * seconds))
    return samples.groupBy("asset_id", F.floor(F.col("frame") / size).cast("long").alias("chunk")).agg(F.min("frame").alias("first_frame"), F.count("*").alias("n_frames"), F.max(F.abs("sample")).alias("peak"))


def autocorrelation_sums(samples: DataFrame, max_lag: int, block: int = BLOCK_FRAMES) -> DataFrame:
    """(asset_id, lag, value): sums of the products of frames that are lag apart, from 0 to max_lag (at most the last frame), of one channel.

    Overlap-save: a task multiplies the spectra of one block of frames and of the same
    block with max_lag frames after it; the blocks' sums add up, so a signal of any
    length is many tasks' work. Frames count up from 0 by 1.
    """
    size = max(block, max_lag, 1)
    width = 1 << (size + max_lag).bit_length()
    place = lambda frame: F.floor(frame / size).cast("long")
    blocks = F.sequence(F.greatest(F.lit(0), place(F.col("frame") - max_lag)), place(F.col("frame")))
    spread = samples.select("asset_id", "frame", F.col("sample").cast("double").alias("sample"), F.explode(blocks).alias("_block"))

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("frame").to_numpy() - rows.column("_block")[0].as_py() * size
        both = np.zeros(size + max_lag)
        both[at] = rows.column("sample").to_numpy()
        lags = min(max_lag, int(at.max()))
        found = np.fft.irfft(np.conj(np.fft.rfft(both[:size], width)) * np.fft.rfft(both, width), width)[: lags + 1]
        return pa.table({"asset_id": pa.array([rows.column("asset_id")[0].as_py()] * (lags + 1), pa.int64()), "lag": np.arange(lags + 1), "value": found})

    # A block's frames with those after it are one group.
    parts = spread.groupBy("asset_id", "_block").applyInArrow(run, "asset_id long, lag long, value double")
    return parts.groupBy("asset_id", "lag").agg(F.sum("value").alias("value"))
