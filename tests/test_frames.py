from __future__ import annotations

import json

import numpy as np
import pytest

from sightline.operators import audio, frames
from sightline.operators.checks import InvalidInput


def video(spark, times, name="v"):
    return spark.createDataFrame([(name, i, t) for i, t in enumerate(times)], "video_id string, frame_index bigint, frame_time_us bigint")


def indexes(df):
    return sorted(r.frame_index for r in df.collect())


def test_interval_counts_from_the_last_kept(spark):
    assert indexes(frames.select_interval(video(spark, [0, 400, 500, 900, 1000, 1499, 1500]), 500)) == [0, 2, 4, 6]
    assert indexes(frames.select_interval(video(spark, []), 500)) == []


def test_interval_over_many_batches(spark):
    """What was kept last holds from batch to batch and is forgotten from video to video."""
    import random

    rng = random.Random(3)
    rows, want = [], set()
    for v in range(7):
        time, last = 0, None
        for i in range(rng.choice([1, 40, 900])):
            time += rng.choice([0, 1, 7, 30])
            rows.append((f"v{v}", i, time))
            if last is None or time - last >= 25:
                last = time
                want.add((f"v{v}", i, time))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "video_id string, frame_index bigint, frame_time_us bigint")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "16")
        assert {tuple(r) for r in frames.select_interval(table, 25).collect()} == want
        assert frames.select_interval(table, 0).count() == len(rows)
        with pytest.raises(Exception, match="fall"):
            frames.select_interval(video(spark, [*range(40), 3]), 5).collect()
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize(("n", "most", "kept"), [(10, 4, [0, 3, 6, 9]), (6, 4, [0, 1, 3, 5]), (5, 3, [0, 2, 4]), (4, 2, [0, 3]), (3, 1, [0]), (2, 5, [0, 1]), (7, 7, [*range(7)])])
def test_cap(spark, n, most, kept):
    assert indexes(frames.cap_frames(video(spark, range(n)), most)) == kept


def test_spacing_then_cap(spark):
    assert indexes(frames.bound_density(video(spark, [0, 100, 500, 900, 1000, 1500]), 500, 3)) == [0, 2, 5]


def test_falling_times_and_repeated_indexes_fail(spark):
    with pytest.raises(InvalidInput):
        frames.check_frames(video(spark, [5, 4]))
    with pytest.raises(InvalidInput):
        frames.check_frames(video(spark, [1]).union(video(spark, [1])))


def probe(spark, *times):
    payload = json.dumps({"frames": [{} if t is None else {"best_effort_timestamp_time": t} for t in times]})
    return spark.createDataFrame([("v", payload)], "video_id string, payload string")


def test_probe_rounds_half_even_and_skips_before_zero(spark):
    found = frames.parse_probe(probe(spark, "-0.04", "0.0000005", "0.0000015", "1.25")).orderBy("frame_index").collect()
    assert [(r.frame_index, r.frame_time_us) for r in found] == [(1, 0), (2, 2), (3, 1_250_000)]


@pytest.mark.parametrize("times", [("N/A",), (None,), ("-1",), ("2", "1"), ()])
def test_bad_probes_fail(spark, times):
    with pytest.raises(InvalidInput):
        frames.parse_probe(probe(spark, *times)).collect()


def samples(spark, first, second):
    n = max(len(first), len(second))
    rows = [("p", i, first[i] if i < len(first) else None, second[i] if i < len(second) else None) for i in range(n)]
    return spark.createDataFrame(rows, "pair_id string, n int, first int, second int")


def lag(spark, first, second, max_lag=4, overlap=4, least=0.5):
    rows = samples(spark, first, second)
    return audio.best_lag(rows, audio.correlate(rows, max_lag, overlap), least, 8000).first()


def test_known_lag(spark):
    tone = [3, -7, 11, 0, 5, -9, 2, 8, -4, 6, 1, -3]
    row = lag(spark, tone, [9, 9, *tone])
    assert (row.evidence, row.lag, row.offset_us, row.correlation) == ("ACCEPTED", 2, 250, 1.0)


def test_ties_silence_and_weak(spark):
    tie = lag(spark, [10000, -10000] * 6, [10000, -10000] * 6)
    assert (tie.evidence, tie.lag, tie.correlation, tie.offset_us) == ("AMBIGUOUS", 0, 1.0, None)
    silent = lag(spark, [0] * 8, [0] * 8)
    assert (silent.evidence, silent.overlap, silent.correlation, silent.status) == ("UNAVAILABLE", 0, 0.0, "UNRESOLVED")
    assert lag(spark, [1, 2, 1, 3, 1, 2], [5, 5, 4, 5, 5, 4], max_lag=0, least=0.99).evidence == "WEAK"


@pytest.mark.parametrize("bits", [4, 16, 20])
def test_lag_sums_are_exact(bits):
    rng = np.random.default_rng(bits)
    for n, lags in ((1, 1), (70, 3), (200, 64), (3000, 401)):
        x, y = (rng.integers(-(1 << bits), 1 << bits, size).astype(np.int64) for size in (n, n + lags - 1))
        assert audio.lag_sums(x, y, lags).tolist() == [int(sum(int(a) * int(b) for a, b in zip(x, y[k:], strict=False))) for k in range(lags)]
    with pytest.raises(OverflowError):
        audio.lag_sums(np.array([1 << 32] * 3), np.array([1 << 32] * 3), 1)


@pytest.mark.parametrize(("max_lag", "chunk"), [(3, 5), (40, 64), (100, 1 << 16)])
def test_correlations_over_chunks(spark, max_lag, chunk):
    """Tracks of unequal length with holes, cut into chunks: sums by lag as brute force takes them."""
    from statistics import correlation

    rng = np.random.default_rng(9)
    first, second = ([None if rng.random() < 0.05 else int(v) for v in rng.integers(-30000, 30000, n)] for n in (700, 640))
    found = {r.lag: (r.overlap, r.correlation) for r in audio.correlate(samples(spark, first, second), max_lag, 8, chunk=chunk).collect()}
    want = {}
    for k in range(-max_lag, max_lag + 1):
        pairs = [(a, second[i + k]) for i, a in enumerate(first) if a is not None and 0 <= i + k < len(second) and second[i + k] is not None]
        want[k] = (len(pairs), correlation(*zip(*pairs, strict=True)))
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert all(found[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)
