"""Lag of two sound tracks by normalised cross-correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shipping import ship_package
from .checks import InvalidInput

#: Bits of the parts in which numbers go through the transform, so that every sum of products rounds to the right whole number.
LIMB = 11
#: From so many lags on, sums are taken by fast Fourier transform.
MANY_LAGS = 64


def lag_offset_us(lag_samples: Column, sample_rate_hz: int) -> Column:
    """Microseconds of a lag, rounded half-even."""
    return F.bround(lag_samples.cast("decimal(20,0)") * 1000000 / F.lit(sample_rate_hz).cast("decimal(10,0)"), 0).cast("bigint")


def _limbs(v: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as sums of parts times powers of 2**LIMB."""
    out = []
    while np.abs(v).max(initial=0) >> LIMB:
        out.append((v & ((1 << LIMB) - 1)).astype(np.float64))
        v = v >> LIMB
    return [*out, v.astype(np.float64)]


def lag_sums(x: np.ndarray, y: np.ndarray, lags: int) -> np.ndarray:
    """sum(x[i] * y[i + k]) for k below lags; y has lags - 1 numbers more than x. Exact, or OverflowError."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * len(x)
    if most >= 1 << 63:
        raise OverflowError("the samples are too large for sums of 64 bits")
    if lags < MANY_LAGS or len(x) < MANY_LAGS:
        return np.array([x @ y[k : k + len(x)] for k in range(lags)], np.int64)
    size = 1 << (len(y) - 1).bit_length()
    ones, twos = ([np.fft.rfft(part, size) for part in _limbs(v)] for v in (x, y))
    out = np.zeros(lags, np.int64)
    for power in range(len(ones) + len(twos) - 1):
        pairs = [np.conj(ones[i]) * twos[power - i] for i in range(len(ones)) if 0 <= power - i < len(twos)]
        out += sum(np.rint(np.fft.irfft(p, size)[:lags]).astype(np.int64) for p in pairs) << LIMB * power
    return out


def correlate(samples: DataFrame, max_lag: int, minimum_overlap: int, *, digits: int = 9, chunk: int = 1 << 16) -> DataFrame:
    """pair_id, lag, overlap, correlation for each lag that leaves enough overlap.

    samples has pair_id, n (0, 1, ..., each once), first, second; the tracks may
    end at different n, with null beyond. A lag pairs first[n] with second[n + lag].
    Tracks are cut into chunks of `chunk` samples (four times max_lag at least),
    to which the second track is sent with max_lag samples more on either side,
    so a sample goes to at most three chunks whatever the lags and a long track
    to many tasks. Sums are of whole numbers and exact; the result is
    rounded to `digits`, so equal correlations tie. Silent overlaps have none.
    """
    ship_package(samples.sparkSession)
    chunk = max(chunk, 4 * max_lag)
    first = samples.where("first is not null").select("pair_id", F.expr(f"n div {chunk}").alias("c"), F.lit(0).alias("side"), F.col("n").cast("bigint").alias("n"), F.col("first").cast("bigint").alias("v"))
    reached = F.sequence(F.floor((F.col("n") - max_lag) / chunk).cast("bigint"), F.floor((F.col("n") + max_lag) / chunk).cast("bigint"))
    second = samples.where("second is not null").select("pair_id", F.explode(reached).alias("c"), F.lit(1).alias("side"), F.col("n").cast("bigint").alias("n"), F.col("second").cast("bigint").alias("v"))
    names = ("lag", "overlap", "sx", "sy", "sxy", "sxx", "syy")
    schema = StructType([StructField("pair_id", samples.schema["pair_id"].dataType), *(StructField(n, LongType()) for n in names)])

    def sums_of(key: tuple, rows: pa.Table) -> pa.Table:
        side, n, v = (rows.column(c).to_numpy() for c in ("side", "n", "v"))
        start = key[1].as_py() * chunk
        tracks = []
        for which, low, size in ((0, start, chunk), (1, start - max_lag, chunk + 2 * max_lag)):
            value, held = np.zeros(size, np.int64), np.zeros(size, np.int64)
            own = side == which
            np.add.at(held, n[own] - low, 1)
            value[n[own] - low] = v[own]
            if held.max(initial=0) > 1:
                raise InvalidInput(f"a sample of {key[0].as_py()} comes twice")
            tracks.append((value, held))
        (x, mx), (y, my) = tracks
        end = int(np.flatnonzero(mx).max(initial=-1)) + 1  # beyond the end of a track is nothing to add
        x, mx, y, my = x[:end], mx[:end], y[: end + 2 * max_lag], my[: end + 2 * max_lag]
        lags = 2 * max_lag + 1
        table = [np.arange(-max_lag, max_lag + 1), *(lag_sums(a, b, lags) for a, b in ((mx, my), (x, my), (mx, y), (x, y), (x * x, my), (mx, y * y)))] if end else [np.empty(0, np.int64)] * 7
        some = table[1] > 0
        return pa.table([pa.array([key[0].as_py()] * int(some.sum()), rows.schema.field("pair_id").type), *(pa.array(c[some], pa.int64()) for c in table)], names=schema.names)

    parts = first.unionByName(second).groupBy("pair_id", "c").applyInArrow(sums_of, schema)
    sums = parts.groupBy("pair_id", "lag").agg(*(F.sum(c).alias(c) for c in names[1:])).withColumn("lag", F.col("lag").cast("int"))
    n = F.col("overlap").cast("decimal(20,0)")
    dec = lambda c: F.col(c).cast("decimal(18,0)")
    cov = (n * dec("sxy") - dec("sx") * dec("sy")).cast("double")
    vx, vy = (n * dec("sxx") - dec("sx") * dec("sx")).cast("double"), (n * dec("syy") - dec("sy") * dec("sy")).cast("double")
    r = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))), digits)
    return sums.where(F.col("overlap") >= minimum_overlap).where((vx > 0) & (vy > 0)).select("pair_id", "lag", "overlap", r.alias("correlation"))


def best_lag(pairs: DataFrame, correlations: DataFrame, minimum_correlation: float, sample_rate_hz: int) -> DataFrame:
    """pair_id, evidence, lag, overlap, correlation, status, offset_us: the highest correlation of each pair.

    Ties go to the smaller distance, then the smaller lag, and are AMBIGUOUS;
    below the minimum is WEAK, no lag at all UNAVAILABLE. Only ACCEPTED is SUPPORTED and has an offset.
    """
    w = Window.partitionBy("pair_id")
    ranked = correlations.withColumn("top", F.max("correlation").over(w)).where("correlation = top")
    best = ranked.groupBy("pair_id").agg(F.min(F.struct(F.abs("lag").alias("d"), F.col("lag"), F.col("overlap"))).alias("b"), F.max("correlation").alias("correlation"), F.count("*").alias("tied"))
    joined = pairs.select("pair_id").distinct().join(best, "pair_id", "left")
    evidence = F.when(F.col("tied").isNull(), "UNAVAILABLE").when(F.col("correlation") < minimum_correlation, "WEAK").when(F.col("tied") > 1, "AMBIGUOUS").otherwise("ACCEPTED")
    out = joined.select("pair_id", evidence.alias("evidence"), F.coalesce("b.lag", F.lit(0)).alias("lag"), F.coalesce("b.overlap", F.lit(0)).alias("overlap"), F.coalesce("correlation", F.lit(0.0)).alias("correlation"))
    accepted = F.col("evidence") == "ACCEPTED"
    return out.withColumn("status", F.when(accepted, "SUPPORTED").otherwise("UNRESOLVED")).withColumn("offset_us", F.when(accepted, lag_offset_us(F.col("lag"), sample_rate_hz)))
