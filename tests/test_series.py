"""Whole series against plain versions, whatever the width of the blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossloom.functions import sequence
from glossloom.operators import series

WIDTHS = (3, 10, 1_000_000)


@pytest.fixture(scope="module")
def rows(spark):
    """A hot series, short ones, one without values; a third of the values missing in v."""
    rng = random.Random(3)
    made = []
    for u, n in (("hot", 97), ("one", 1), ("two", 2), ("few", 9), ("none", 12)):
        for f in range(n):
            x = round(rng.uniform(-5, 5), 2)
            known = u != "none" and (rng.random() < 0.66 and not 30 <= f < 55)
            made.append((u, f, x, x if known else None, rng.randrange(40)))
    return spark.createDataFrame(made, "u string, frame long, x double, v double, score int").repartition(5).cache()


def by_series(rows, *cols):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.u, r.frame)):
        out.setdefault(r.u, []).append(r if not cols else (r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols)))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for u in want:
        assert got[u] == pytest.approx(want[u], rel=1e-9, abs=1e-9, nan_ok=True), u


@pytest.mark.parametrize("width", WIDTHS)
def test_differences(spark, rows, width):
    def diff(x):
        return [x[max(i, 1)] - x[max(i, 1) - 1] for i in range(len(x))]

    plain = by_series(rows, "x")
    got = series.kinematics(rows, ["u"], "x", width)
    assert by_series(got.filter("u = 'one'"), "vel", "acc") == {"one": [(None, None)]}
    got = got.filter("u <> 'one'")
    plain.pop("one")
    close(by_series(got, "vel"), {u: diff(x) for u, x in plain.items()})
    close(by_series(got, "acc"), {u: diff(diff(x)) for u, x in plain.items()})
    arrays = series.over_blocks(rows, ["u"], "x", sequence.finite_diff, 1, 1, "d", width)
    close(by_series(arrays.filter("u <> 'one'"), "d"), {u: diff(x) for u, x in plain.items()})


@pytest.mark.parametrize("width", WIDTHS)
def test_masked_velocity_and_rolling_mean(spark, rows, width):
    plain = by_series(rows, "x", "v")
    got = series.masked_velocity(rows, ["u"], "x", F.col("v").isNotNull(), width)
    want = {
        u: [p[i][0] - p[i - 1][0] if i and p[i][1] is not None and p[i - 1][1] is not None else 0.0 for i in range(len(p))] for u, p in plain.items()
    }
    close(by_series(got, "vel"), want)
    means = {u: [float(np.mean([x for x, _ in p[max(0, i - 49) : i + 1]])) for i in range(len(p))] for u, p in plain.items()}
    close(by_series(series.rolling_mean(rows, ["u"], "x", 50, "m", width), "m"), means)


def filled(values):
    at = [i for i, v in enumerate(values) if v is not None]
    return np.interp(range(len(values)), at, [values[i] for i in at]).tolist() if at else None


@pytest.mark.parametrize("width", WIDTHS)
def test_gaps_and_smoother(spark, rows, width):
    plain = by_series(rows, "v")
    got = by_series(series.gap_fill(rows, ["u"], "v", "g", width), "g")
    smooth = series.kalman_smooth(rows, ["u"], "v", "s", width=width)
    assert smooth.columns == [*rows.columns, "s"]
    smooth = by_series(smooth, "s")
    assert got.pop("none") == smooth.pop("none") == [None] * 12
    want = {u: w for u, v in plain.items() if (w := filled(v))}
    for u in set(got) - set(want):
        assert got.pop(u) == smooth.pop(u) == [None] * len(plain[u])
    close(got, want)
    arrays = spark.createDataFrame(list(want.items()), "u string, x array<double>")
    close(smooth, {r.u: r.s for r in arrays.select("u", sequence.kalman_smooth(F.col("x")).alias("s")).collect()})


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("patience", (3, 10, 500))
def test_best_epoch(spark, rows, width, patience):
    want = {}
    for u, scores in by_series(rows, "score").items():
        best, at, stop = None, 0, False
        for f, s in enumerate(scores):
            if best is None or s >= best:
                best, at = s, f
            if f - at >= patience:
                stop = True
                break
        want[u] = (best, at, f, stop)
    got = series.best_epoch(rows, ["u"], "score", patience, width).collect()
    assert {r.u: (r.best_score, r.best_epoch, r.last_epoch, r.stopped_early) for r in got} == want


@pytest.mark.parametrize("width", WIDTHS)
def test_sliding_peaks(spark, rows, width):
    got = by_series(series.over_blocks(rows, ["u"], "x", sequence.sliding_peak, 7, 7, "p", width), "p")
    whole = spark.createDataFrame(list(by_series(rows, "x").items()), "u string, x array<double>")
    want = {r.u: r.p for r in whole.select("u", sequence.sliding_peak(F.col("x")).alias("p")).collect()}
    assert got.keys() == want.keys()
    for u in want:
        assert [p.mag for p in got[u]] == pytest.approx([p.mag for p in want[u]])


def test_empty_series(spark, rows):
    none = rows.filter("u = '?'")
    assert series.kalman_smooth(none, ["u"], "v").count() == series.gap_fill(none, ["u"], "v").count() == 0
    assert series.best_epoch(none, ["u"], "score", 3).count() == series.kinematics(none, ["u"], "x").count() == 0


def test_a_hot_series_is_spread(spark, rows):
    sizes = series.in_blocks(rows, ["u"], 10, 2, 2).filter("u = 'hot'").groupBy("_block").count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) <= 14


def test_gains_settle_and_maps_compose():
    gains = sequence.kalman_gains()
    assert len(gains) < 1000
    values = [float(i % 7) for i in range(300)]
    whole = sequence.kalman_run(values, 0, 2.0, -1.0, gains)
    shifted = sequence.kalman_run(values, 0, 0.0, 0.0, gains)
    m = sequence.kalman_map(300, 0, gains)
    assert whole[1] == pytest.approx(shifted[1] + m[0] * 2.0 - m[1]) and whole[2] == pytest.approx(shifted[2] + m[2] * 2.0 - m[3])
    m = sequence.kalman_map(4, 2, gains)
    at = lambda p, v: sequence.kalman_run([0.0] * 4, 2, p, v, gains)[1:]
    assert at(1.0, 0.0) == pytest.approx((m[0], m[2])) and at(0.0, 1.0) == pytest.approx((m[1], m[3]))
