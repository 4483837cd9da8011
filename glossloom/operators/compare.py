"""Paired model comparison and summaries over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.stats import bootstrap_macro_delta, mcnemar_p, mcnemar_winner, paired_bootstrap
from glossloom.functions.text import canonical_model
from glossloom.operators.joins import model_pairs
from glossloom.operators.ranking import median


def discordant(pairs: DataFrame, by: list[str]) -> DataFrame:
    """b: reference right and model wrong; c: the reverse; both from (a_ok, b_ok)."""
    return pairs.groupBy(*by).agg(
        F.count_if(F.col("a_ok") & ~F.col("b_ok")).alias("b"),
        F.count_if(~F.col("a_ok") & F.col("b_ok")).alias("c"),
        F.count(F.lit(1)).alias("n"),
    )


def paired_summary(pairs: DataFrame, by: list[str], is_target=None, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Delta, bootstrap interval, b, c, p and n per group and subset (all, target)."""
    subset = F.array(F.lit("all")) if is_target is None else F.when(
        is_target(F.col("y")), F.array(F.lit("all"), F.lit("target"))
    ).otherwise(F.array(F.lit("all")))
    counts = discordant(pairs.withColumn("subset", F.explode(subset)), [*by, "subset"])
    boot = paired_bootstrap(F.col("b"), F.col("c"), F.col("n"), n_boot, seed)
    return counts.withColumn("_boot", boot).select(
        *by, "subset", F.col("_boot.delta").alias("delta"), F.col("_boot.low").alias("lo"), F.col("_boot.high").alias("hi"),
        "b", "c", mcnemar_p(F.col("b"), F.col("c")).alias("p"), "n",
    )


def all_pairs(preds: DataFrame, on: list[str]) -> DataFrame:
    """McNemar test of every pair of models on one locked item set."""
    rows = model_pairs(preds, on)
    a, b = F.col("a_better"), F.col("b_better")
    return rows.withColumn("p_value", mcnemar_p(a, b)).withColumn("winner", mcnemar_winner(a, b))


def macro_delta(pairs: DataFrame, by: list[str], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Macro-accuracy difference of A and B with shared resamples and significance flags."""
    cells = pairs.groupBy(*by, "y", "a_ok", "b_ok").agg(F.count(F.lit(1)).alias("n"))
    packed = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y", "a_ok", "b_ok", "n"))).alias("cells"))
    out = packed.select(*by, bootstrap_macro_delta(F.col("cells"), n_boot, seed).alias("d"))
    return out.select(
        *by, F.col("d.delta").alias("delta_macro_acc"), F.col("d.low").alias("low"), F.col("d.high").alias("high"),
        (F.col("d.low") > 0).alias("a_beats_b"), (F.col("d.high") < 0).alias("b_beats_a"),
    )


def _value(c: str) -> Column:
    """Metric with NaN as missing."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c))


def summarise(runs: DataFrame, by: list[str], metrics: list[str], single_std_zero: bool = False) -> DataFrame:
    """Mean and sample deviation of every metric, missing values left out, and the seed count.

    One value gives a null deviation, or 0 with single_std_zero.
    """
    aggs = []
    for m in metrics:
        std = F.stddev_samp(_value(m))
        if single_std_zero:
            std = F.when(F.count(_value(m)) == 1, F.lit(0.0)).otherwise(std)
        aggs += [F.avg(_value(m)).alias(f"{m}_mean"), std.alias(f"{m}_std")]
    return runs.groupBy(*by).agg(*aggs, F.count_distinct("seed").alias("n_seeds"))


def pivot_shots(summary: DataFrame, metric: str, shots: list[int], row: str = "model") -> DataFrame:
    """One row per model, mean and deviation per K; best mean at the largest K first."""
    wide = summary.groupBy(row).pivot("k", shots).agg(
        F.first(f"{metric}_mean").alias("mean"), F.first(f"{metric}_std").alias("std")
    )
    return wide.orderBy(F.col(f"{shots[-1]}_mean").desc_nulls_last(), row)


def flag_best(summary: DataFrame, column: str, by: list[str], lower: bool = False) -> DataFrame:
    """Adds `is_best`: within 1e-9 of the best value of its group (map-side combined)."""
    pick = F.min if lower else F.max
    best = summary.groupBy(*by).agg(pick(column).alias("_best"))
    return summary.join(best, by).withColumn("is_best", F.abs(F.col(column) - F.col("_best")) < 1e-9).drop("_best")


def fingerprint_conflicts(runs: DataFrame, by: list[str], fingerprint: str) -> DataFrame:
    """Groups whose runs disagree on the fingerprint."""
    n = F.count_distinct(fingerprint)
    return runs.groupBy(*by).agg(n.alias("n_fingerprints")).filter(F.col("n_fingerprints") > 1)


def short_cells(runs: DataFrame, by: list[str], unit: str = "seed") -> DataFrame:
    """Cells with fewer distinct seeds than the fullest cell."""
    cells = runs.groupBy(*by).agg(F.count_distinct(unit).alias("n_seeds"))
    want = cells.agg(F.max("n_seeds")).scalar()
    return cells.withColumn("want", want).filter(F.col("n_seeds") < F.col("want"))


def calibrate(runs: DataFrame, gpu: str = "T4") -> DataFrame:
    """Median seconds per step and model over finished runs of one device type."""
    ok = (F.col("steps") > 0) & (F.col("train_seconds") > 0) & F.col("gpu").contains(gpu)
    per_step = F.col("train_seconds") / F.col("steps")
    return median(runs.filter(ok).withColumn("model", canonical_model(F.col("model"))), ["model"], per_step, "step_seconds")


def job_cost(jobs: DataFrame, calibrated: DataFrame, defaults: dict[str, float], fallback: float, overhead: float) -> DataFrame:
    """Adds cost in device seconds: calibrated, else planned, else fallback time per step, by canonical model name."""
    planned = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    sec = F.coalesce("step_seconds", F.try_element_at(planned, F.col("_model")), F.lit(fallback))
    ddp = F.coalesce("ddp", F.lit(False))
    run = F.coalesce("steps", F.lit(300)) * sec * F.when(ddp, 0.6).otherwise(1.0) + F.lit(overhead)
    known = calibrated.select(F.col("model").alias("_model"), "step_seconds")
    named = jobs.withColumn("_model", canonical_model(F.col("model"))).join(known, "_model", "left")
    return named.withColumn("cost", run * F.when(ddp, 2).otherwise(1)).drop("step_seconds", "_model")


def step_budget(n_train: Column, batch: Column, epochs: float, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(F.lit(float(epochs)) * n_train / batch)))


def effective_batch(batch: Column, n_train: Column, world: int) -> Column:
    """At most the training size, at least two per worker, divisible by the workers."""
    b = F.greatest(F.least(batch, n_train), F.lit(2 * world))
    return F.ceil(b / F.lit(world)) * F.lit(world)
