"""Poisson weights and the bootstraps built on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossloom.functions.stats import bootstrap_cells, MACRO_METRICS
from glossloom.operators import resample


@pytest.mark.parametrize("n", (0, 1, 9, 256, 257, 5000))
def test_weights_follow_the_distribution(spark, n):
    rows = resample.resamples(spark.createDataFrame([("g", "c", n)], "g string, c string, n long"), ["g"], ["c"], n_boot=20_000)
    w = np.array([r.w for r in rows.orderBy("resample").collect()])
    assert w[0] == n and len(w) == 20_001 and w.min() >= 0
    drawn = w[1:]
    assert abs(drawn.mean() - n) <= 5 * math.sqrt(max(n, 1e-9) / 20_000) and drawn.var() == pytest.approx(n, rel=0.06)
    if 0 < n < 300:
        for k in (n - 1, n, n + 2):
            cdf = sum(math.exp(i * math.log(n) - n - math.lgamma(i + 1)) for i in range(k + 1))
            assert (drawn <= k).mean() == pytest.approx(cdf, abs=0.02)


def test_weights_do_not_depend_on_partitions_and_differ_by_seed(spark):
    cells = spark.createDataFrame([(i % 3, i, 1 + i % 40) for i in range(60)], "g int, c int, n long")
    draw = lambda df, seed: {(r.g, r.c, r.resample): r.w for r in resample.resamples(df, ["g"], ["c"], n_boot=20, seed=seed).collect()}
    assert draw(cells, 0) == draw(cells.repartition(7), 0) != draw(cells, 1)


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(2)
    made = []
    for run in range(2):
        y = rng.integers(0, 6, 300)
        pred = np.where(rng.random(300) < 0.7, y, rng.integers(0, 7, 300))
        made += [(run, int(a), int(b)) for a, b in zip(y, pred)]
    return spark.createDataFrame(made, "run int, y int, pred int").cache()


def test_split_scores_agree_with_row_resampling(spark, preds):
    got = {r.run: r for r in resample.split_scores(preds, ["run"], F.lit(1.0), 1500).collect()}
    for run, r in got.items():
        counts = preds.filter(F.col("run") == run).groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n")).collect()
        for name in ("macro_acc", "macro_f1"):
            point, low, high = bootstrap_cells(counts, MACRO_METRICS[name], 3000, 1)
            assert r[name] == pytest.approx(point)
            assert (r[f"{name}_low"], r[f"{name}_high"]) == pytest.approx((low, high), abs=0.012)
        assert r.n == 300 and r.overall_low < r.overall < r.overall_high and r.val_test_gap == pytest.approx(1 - r.macro_acc)


def test_macro_delta_and_paired_delta(spark):
    rng = np.random.default_rng(5)
    pairs = [("m", int(y), bool(rng.random() < 0.9), bool(rng.random() < 0.6)) for y in rng.integers(0, 4, 400)]
    df = spark.createDataFrame(pairs, "m string, y int, a_ok boolean, b_ok boolean")
    row = resample.macro_delta(df, ["m"], 800).first()
    by_class = [np.mean([a - b for _, y, a, b in pairs if y == k]) for k in range(4)]
    assert row.delta_macro_acc == pytest.approx(np.mean(by_class)) and row.low < row.delta_macro_acc < row.high
    assert row.a_beats_b and not row.b_beats_a
    one = resample.paired_summary(df, ["m"], lambda y: y < 2, 2000).filter("subset = 'all'").first()
    b, c = sum(a and not x for _, _, a, x in pairs), sum(x and not a for _, _, a, x in pairs)
    draw = np.random.default_rng(0).multinomial(400, [b / 400, c / 400, 1 - (b + c) / 400], 4000)
    low, high = np.quantile((draw[:, 1] - draw[:, 0]) / 400, [0.025, 0.975])
    assert (one.b, one.c, one.delta) == (b, c, pytest.approx((c - b) / 400)) and (one.lo, one.hi) == pytest.approx((low, high), abs=0.012)


def test_any_metric_and_empty_input(spark, preds):
    cells = preds.groupBy("run", "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    error = F.sum(F.when(F.col("y") != F.col("pred"), F.col("w")).otherwise(0)) / F.sum("w")
    for r in resample.metric_interval(resample.resamples(cells, ["run"], ["y", "pred"], n_boot=300), ["run"], error).collect():
        wrong = preds.filter((F.col("run") == r.run) & (F.col("y") != F.col("pred"))).count()
        assert r.point == pytest.approx(wrong / 300) and r.point_low < r.point < r.point_high
    none = preds.filter("run > 5")
    assert resample.split_scores(none, ["run"], None, 20).count() == 0
