"""Prototype classification and prediction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.bind import let
from glossloom.functions.stats import bootstrap_metric, wilson

# A prototype table is broadcast up to this size.
BROADCAST_BYTES = 64 * 1024 * 1024


def unit(vec: Column) -> Column:
    """Vector divided by its length plus 1e-8."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-8)
    return let(vec, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def prototypes(train: DataFrame, by: list[str], label: str, vec: str) -> DataFrame:
    """Unit class means: (by, label, proto). Means are combined map-side, dimension by dimension."""
    long = train.select(*by, label, F.posexplode_outer(unit(F.col(vec))).alias("d", "v"))
    mean = long.groupBy(*by, label, "d").agg(F.avg("v").alias("v"))
    whole = mean.groupBy(*by, label).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("p"))
    return whole.select(*by, label, unit(F.transform("p", lambda e: e["v"])).alias("proto"))


def nearest_prototype(
    items: DataFrame, protos: DataFrame, by: list[str], label: str, vec: str, n_classes: int, n_groups: int = 1,
    dims: int = 64, top: int = 5, block: int = 2_000,
) -> DataFrame:
    """Adds `ranked`: the `top` best classes by cosine, ties to the lower label, and `pred`.

    Classes are packed into blocks of at most about `block` prototypes. Usually one
    block per group is enough and items are scored in place; with more, every item
    meets each block and the best classes are merged. The packed table is broadcast
    only while its size, known from the counts, is small.
    """
    n_blocks = max(1, -(-n_classes // block))
    packed = protos.withColumn("_b", F.pmod(F.xxhash64(label), F.lit(n_blocks)))
    packed = packed.groupBy(*by, "_b").agg(F.collect_list(F.struct(F.col(label).alias("c"), F.col("proto").alias("p"))).alias("_ps"))
    if n_groups * n_classes * dims * 8 <= BROADCAST_BYTES:
        packed = F.broadcast(packed)
    rows = items.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    joined = rows.withColumn("_u", unit(F.col(vec))).join(packed, [*by, "_b"])
    best = F.slice(
        F.array_sort(F.transform("_ps", lambda e: F.struct((-dot(e["p"], F.col("_u"))).alias("s"), e["c"].alias("c")))), 1, top
    )
    scored = joined.withColumn("_best", best).drop("_ps", "_u", "_b")
    if n_blocks > 1:
        keep = [c for c in items.columns if c != vec]
        scored = scored.groupBy(*keep).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, top).alias("_best"))
    return scored.withColumn("ranked", F.transform("_best", lambda e: e["c"])).withColumn(
        "pred", F.get("ranked", F.lit(0))
    ).drop("_best")


def ok_col() -> Column:
    return (F.col("y") == F.col("pred")).cast("int")


def run_metrics(preds: DataFrame, by: list[str], is_target, ranked: str | None = None) -> DataFrame:
    """Accuracy overall, on target and on other classes; absorption rates; top-5.

    `is_target` maps a class column to a boolean column. Empty subsets give null.
    """
    t, pt, ok = is_target(F.col("y")), is_target(F.col("pred")), ok_col()
    aggs = [
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(t).alias("n_test_target"),
        F.sum(ok).alias("n_ok"),
        F.avg(ok).alias("top1"),
        F.avg(F.when(t, ok)).alias("target_top1"),
        F.avg(F.when(~t, ok)).alias("rich_top1"),
        F.avg(F.when(t, (~pt).cast("int"))).alias("target_to_rich_rate"),
        F.avg(F.when(~t, pt.cast("int"))).alias("rich_to_target_rate"),
    ]
    if ranked:
        hit = F.array_contains(F.slice(ranked, 1, 5), F.col("y")).cast("int")
        enough = F.size(ranked) >= 5
        aggs += [F.avg(F.when(enough, hit)).alias("top5"), F.avg(F.when(enough & t, hit)).alias("target_top5")]
    out = preds.groupBy(*by).agg(*aggs)
    ci = wilson(F.col("n_ok"), F.col("n_test"))
    return out.withColumn("top1_low", ci["low"]).withColumn("top1_high", ci["high"])


def confusion(preds: DataFrame, by: list[str]) -> DataFrame:
    return preds.groupBy(*by, "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def _class_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp and fn of every class that occurs as label or prediction."""
    hit = F.col("y") == F.col("pred")
    side = F.explode(
        F.when(hit, F.array(F.struct(F.col("y").alias("c"), F.lit("tp").alias("k")))).otherwise(
            F.array(F.struct(F.col("y").alias("c"), F.lit("fn").alias("k")), F.struct(F.col("pred").alias("c"), F.lit("fp").alias("k")))
        )
    ).alias("e")
    rows = cells.select(*by, side, "n")
    sums = [F.sum(F.when(F.col("e.k") == k, F.col("n")).otherwise(0)).alias(k) for k in ("tp", "fp", "fn")]
    return rows.groupBy(*by, F.col("e.c").alias("class")).agg(*sums)


def macro_f1(preds: DataFrame, by: list[str], classes: str = "present") -> DataFrame:
    """Mean F1 over the classes present as label, or over the union of labels and predictions."""
    counts = _class_counts(confusion(preds, by), by)
    if classes == "present":
        counts = counts.filter(F.col("tp") + F.col("fn") > 0)
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.groupBy(*by).agg(F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def macro_accuracy(preds: DataFrame, by: list[str]) -> DataFrame:
    per = preds.groupBy(*by, "y").agg(F.avg(ok_col()).alias("a"))
    return per.groupBy(*by).agg(F.avg("a").alias("macro_acc"))


def per_class_scores(preds: DataFrame, by: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Per class: n, correct, errors, clamped Wilson bounds, most confused class (lowest of ties)."""
    cells = confusion(preds, by)
    wrong = F.col("y") != F.col("pred")
    rows = cells.groupBy(*by, "y").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(~wrong, F.col("n")).otherwise(0)).alias("correct"),
        F.max(F.when(wrong, F.struct("n", (-F.col("pred")).alias("low")))).alias("_m"),
    )
    if labels is not None:
        rows = labels.join(rows, [*by, "y"], "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("correct", F.lit(0))
    ci = wilson(k, n, clamp=True)
    return rows.select(
        *by, "y", n.alias("n"), k.alias("correct"), (n - k).alias("errors"), ci["p"].alias("acc"),
        ci["low"].alias("low"), ci["high"].alias("high"), (-F.col("_m.low")).alias("confused_with"),
    )


def per_word_top1(preds: DataFrame, by: list[str]) -> DataFrame:
    """Map class -> accuracy per run (one entry per class)."""
    per = preds.groupBy(*by, "y").agg(F.avg(ok_col()).alias("a"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("y").cast("string").alias("k"), F.col("a").alias("v"))))
    return per.groupBy(*by).agg(F.map_from_entries(entries).alias("per_word_top1"))


def class_weights(train: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights that sum to the number of classes; absent classes count 1."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows = labels.join(counts, label, "left").select(label, (1 / F.coalesce("n", F.lit(1))).alias("w"))
    mean = rows.agg(F.sum("w") / F.count(F.lit(1))).scalar()
    return rows.select(label, (F.col("w") / mean).alias("weight"))


def weighted_mean(df: DataFrame, by: list[str], loss: str, acc: str, size: str) -> DataFrame:
    """Sample-weighted loss and accuracy over batches."""
    n = F.sum(size)
    mean = lambda c: F.sum(F.col(c) * F.col(size)) / F.greatest(n, F.lit(1))
    return df.groupBy(*by).agg(mean(loss).alias("loss"), mean(acc).alias("acc"), n.alias("n"))


def confusion_cells(preds: DataFrame, by: list[str]) -> DataFrame:
    """All confusion cells of a run in one array (classes squared at most)."""
    return confusion(preds, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y", "pred", "n"))).alias("cells"))


def score_split(preds: DataFrame, by: list[str], best_val: Column | None = None, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Overall Wilson interval, bootstrap intervals of macro accuracy and macro F1, val-test gap."""
    cells = confusion_cells(preds, by)
    acc = bootstrap_metric(F.col("cells"), "macro_acc", n_boot, seed)
    f1 = bootstrap_metric(F.col("cells"), "macro_f1", n_boot, seed + 1)
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    right = F.aggregate(
        "cells", F.lit(0).cast("bigint"), lambda s, c: s + F.when(c["y"] == c["pred"], c["n"]).otherwise(F.lit(0).cast("bigint"))
    )
    out = cells.select(*by, total.alias("n"), wilson(right, total, clamp=True).alias("overall"), acc.alias("macro_acc"), f1.alias("macro_f1"))
    gap = F.lit(None).cast("double") if best_val is None else best_val - F.col("macro_acc.point")
    return out.withColumn("val_test_gap", gap)
