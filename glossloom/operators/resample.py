"""Bootstraps as joins and sums: every cell of counts gets a Poisson weight per resample.

An item drawn with replacement from many is in a resample a Poisson(1) number of
times, so a cell of n equal items weighs Poisson(n). The weight comes from a hash of
seed, group, cell and resample alone: cells are resampled wherever they are, no group
is gathered in one row or task, and reruns and other engines agree. Resample 0 holds
the counts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.bind import let
from glossloom.functions.hashing import seeded_order, unit_interval
from glossloom.functions.stats import mcnemar_p, wilson
from glossloom.operators.augment import gaussian
from glossloom.operators.compare import discordant
from glossloom.operators.score import confusion

#: Counts up to this are drawn by inverting the distribution itself, larger ones by its normal
#: expansion, which then differs by less than half a count.
EXACT = 256


def poisson_cdf(n: Column) -> Column:
    """P(X <= k) for k = 0 .. n + 9 sqrt(n) + 20 of a Poisson variable with mean n, as an array."""
    terms = F.sequence(F.lit(1).cast("bigint"), (n + F.ceil(F.sqrt(n) * 9) + 20).cast("bigint"))
    state = lambda p, out: F.struct(p.alias("p"), out.alias("out"))
    first = F.exp(-n.cast("double"))
    step = lambda s, k: let(s["p"] * n / k, lambda p: state(p, F.concat(s["out"], F.array(F.element_at(s["out"], -1) + p))))
    return F.aggregate(terms, state(first, F.array(first)), step, lambda s: s["out"])


def poisson(n: Column, cdf: Column, *salt) -> Column:
    """Seeded Poisson draw with mean n; cdf is poisson_cdf(n) where n is at most EXACT."""
    below = lambda u: F.size(F.filter(cdf, lambda c: c < u)).cast("bigint")
    wide = let(gaussian(*salt), lambda z: F.greatest(F.lit(0.0), F.bround(n + F.sqrt(n) * z + (z * z - 1) / 6)).cast("bigint"))
    return F.when(n <= EXACT, let(unit_interval(seeded_order(*salt)), below)).otherwise(wide)


def resamples(cells: DataFrame, by: list[str], key: list[str], n: str = "n", n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """One row per cell and resample with its weight w; by and key name the cell.

    Cells are few bytes but much work: they are spread by a fixed number of partitions,
    which adaptive execution does not merge.
    """
    count = F.col(n).cast("bigint")
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, *key]])
    cell = F.struct(name.alias("name"), F.when(count <= EXACT, poisson_cdf(count)).alias("cdf"))
    draw = lambda r, c: F.when(r == 0, count).otherwise(poisson(count, c["cdf"], c["name"], r))
    weights = let(cell, lambda c: F.transform(F.sequence(F.lit(0), F.lit(n_boot)), lambda r: draw(r, c)))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(tasks, *by, *key).select(*by, *key, F.posexplode_outer(weights).alias("resample", "w"))


def intervals(scores: DataFrame, by: list[str], *values: str) -> DataFrame:
    """Per value its figure of resample 0 and, as value_low and value_high, the 95 % interval of the others.

    Resamples without a value do not count.
    """
    drawn = lambda v: F.percentile(F.when(F.col("resample") > 0, F.col(v)), F.array(F.lit(0.025), F.lit(0.975)))
    whole = lambda v: F.max(F.when(F.col("resample") == 0, F.col(v)))
    got = scores.groupBy(*by).agg(*[whole(v).alias(v) for v in values], *[drawn(v).alias(f"_{v}") for v in values])
    ends = [F.get(f"_{v}", F.lit(i)).alias(f"{v}_{end}") for v in values for i, end in enumerate(("low", "high"))]
    return got.select(*by, *values, *ends)


def metric_interval(drawn: DataFrame, by: list[str], metric: Column, name: str = "point") -> DataFrame:
    """Interval of any metric that is one aggregate over cells and their weights w."""
    return intervals(drawn.groupBy(*by, "resample").agg(metric.alias(name)), by, name)


def macro_scores(drawn: DataFrame, by: list[str]) -> DataFrame:
    """macro_acc over the drawn labels and macro_f1 over the drawn labels and predictions, for every resample."""
    side = lambda c, own, hit: F.struct(F.col(c).alias("c"), F.lit(own).alias("own"), F.lit(hit).alias("hit"), F.lit(1).alias("seen"))
    both = F.struct(F.col("y").alias("c"), F.lit(1).alias("own"), F.lit(1).alias("hit"), F.lit(2).alias("seen"))
    sides = F.when(F.col("y") == F.col("pred"), F.array(both)).otherwise(F.array(side("y", 1, 0), side("pred", 0, 0)))
    each = drawn.select(*by, "resample", "w", F.explode_outer(sides).alias("s"))
    per = each.groupBy(*by, "resample", "s.c").agg(*[F.sum(F.col("w") * F.col(f"s.{c}")).alias(f"_{c}") for c in ("own", "hit", "seen")])
    return per.groupBy(*by, "resample").agg(
        F.avg(F.try_divide("_hit", "_own")).alias("macro_acc"), F.avg(F.try_divide(2 * F.col("_hit"), F.col("_seen"))).alias("macro_f1")
    )


def split_scores(preds: DataFrame, by: list[str], best_val: Column | None = None, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Overall Wilson interval, intervals of macro accuracy and macro F1, val-test gap."""
    cells = confusion(preds, by)
    right = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0))
    ci = wilson(F.col("_k"), F.col("n"), clamp=True)
    whole = cells.groupBy(*by).agg(F.sum("n").alias("n"), right.alias("_k")).select(
        *by, "n", ci["p"].alias("overall"), ci["low"].alias("overall_low"), ci["high"].alias("overall_high")
    )
    macros = intervals(macro_scores(resamples(cells, by, ["y", "pred"], "n", n_boot, seed), by), by, "macro_acc", "macro_f1")
    gap = F.lit(None).cast("double") if best_val is None else best_val - F.col("macro_acc")
    return whole.join(macros, by).withColumn("val_test_gap", gap)


def macro_delta(pairs: DataFrame, by: list[str], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Macro-accuracy difference of A and B on shared resamples, with significance flags."""
    cells = pairs.groupBy(*by, "y", "a_ok", "b_ok").agg(F.count(F.lit(1)).alias("n"))
    right = lambda c: F.sum(F.when(F.col(c), F.col("w")).otherwise(0))
    per = resamples(cells, by, ["y", "a_ok", "b_ok"], "n", n_boot, seed).groupBy(*by, "resample", "y").agg(F.sum("w").alias("_n"), (right("a_ok") - right("b_ok")).alias("_d"))
    out = intervals(per.groupBy(*by, "resample").agg(F.avg(F.try_divide("_d", "_n")).alias("delta")), by, "delta")
    low, high = F.col("delta_low"), F.col("delta_high")
    return out.select(*by, F.col("delta").alias("delta_macro_acc"), low.alias("low"), high.alias("high"), (low > 0).alias("a_beats_b"), (high < 0).alias("b_beats_a"))


def delta_interval(counts: DataFrame, by: list[str], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Adds delta, delta_low, delta_high of the accuracy difference (c - b) / n to discordant counts b, c, n."""
    cell = lambda name, n: F.struct(F.lit(name).alias("cell"), n.cast("bigint").alias("_n"))
    b, c = F.col("b"), F.col("c")
    cells = counts.select(*by, F.explode_outer(F.array(cell("b", b), cell("c", c), cell("rest", F.col("n") - b - c))).alias("e")).select(*by, "e.*")
    sign = F.when(F.col("cell") == "c", F.col("w")).when(F.col("cell") == "b", -F.col("w")).otherwise(0)
    found = metric_interval(resamples(cells, by, ["cell"], "_n", n_boot, seed), by, F.try_divide(F.sum(sign), F.sum("w")), "delta")
    return counts.join(found, by)


def paired_summary(pairs: DataFrame, by: list[str], is_target=None, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Delta, its interval, b, c, p and n per group and subset (all, target)."""
    every = F.array(F.lit("all"))
    subset = every if is_target is None else F.when(is_target(F.col("y")), F.array(F.lit("all"), F.lit("target"))).otherwise(every)
    counts = discordant(pairs.withColumn("subset", F.explode(subset)), [*by, "subset"])
    rows = delta_interval(counts, [*by, "subset"], n_boot, seed)
    return rows.select(*by, "subset", "delta", F.col("delta_low").alias("lo"), F.col("delta_high").alias("hi"), "b", "c", mcnemar_p(F.col("b"), F.col("c")).alias("p"), "n")
