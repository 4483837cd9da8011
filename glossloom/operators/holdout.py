"""Order-dependent identity holdout.

Identities are visited in a seeded order and moved to the test side one by one.
Counts only grow, so an identity that does not fit (or no longer helps) is out for
good. Each round therefore filters all remaining identities in parallel, takes the
next `chunk` of them per seed in order, and folds just that chunk; the fold sees at
most `chunk` identities of a seed and the word limits, never a whole group.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.hashing import seeded_order
from glossloom.operators.joins import small_side
from glossloom.operators.ranking import cap_per_group
from glossloom.session import checkpoint


def identity_counts(clips: DataFrame) -> DataFrame:
    return clips.groupBy("identity", "word").agg(F.count(F.lit(1)).alias("n"))


def test_limits(counts: DataFrame, frac=0.25, min_test=2, max_test: int | None = 20, max_frac=0.5) -> DataFrame:
    """Per word: test target (half-even share within bounds) and the most it may get."""
    total = counts.groupBy("word").agg(F.sum("n").alias("total"))
    share = F.greatest(F.lit(min_test), F.bround(F.lit(frac) * F.col("total")).cast("bigint"))
    target = F.least(share, F.lit(max_test) if max_test else F.col("total"))
    cap = F.greatest(F.col("target"), F.floor(F.lit(max_frac) * F.col("total")))
    return total.withColumn("target", target).withColumn("cap", cap).select("word", "target", "cap")


def _fold(need_help: bool):
    def visit(chunk: pd.DataFrame, limits: pd.DataFrame) -> pd.DataFrame:
        have = dict(zip(limits["word"], limits["have"]))
        target = dict(zip(limits["word"], limits["target"]))
        cap = dict(zip(limits["word"], limits["cap"]))
        open_words = sum(have[w] < target[w] for w in have)
        taken = []
        for items in chunk.sort_values("h")["items"]:
            items = [(i["word"], i["n"]) for i in items]
            if need_help:
                ok = any(have[w] < target[w] for w, _ in items)
            else:
                ok = open_words > 0
            ok = ok and all(have[w] + n <= cap[w] for w, n in items)
            taken.append(bool(ok))
            if ok:
                for w, n in items:
                    open_words -= have[w] < target[w] <= have[w] + n
                    have[w] += n
        out = chunk.sort_values("h")[["seed", "identity", "h"]].copy()
        out["taken"] = taken
        return out

    return visit


def greedy_holdout(
    counts: DataFrame, limits: DataFrame, seeds: list[int], salt: str, need_help: bool, chunk: int = 5000
) -> DataFrame:
    """(seed, identity) of the test side.

    need_help=True: an identity is taken if one of its words is below target.
    need_help=False: identities are taken until every word has its target.
    """
    each = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    order = seeded_order(F.col("seed"), salt, F.col("identity"))
    rows = counts.select(each, "identity", "word", "n").withColumn("h", order)
    have = checkpoint(limits.select(each, "word", "target", "cap", F.lit(0).cast("bigint").alias("have")))
    left: Column = F.lit(True)
    taken = None
    while True:
        is_open = F.col("have") < F.col("target")
        # Few words and seeds: a join by them would bring all identities of one into one task.
        live = rows.filter(left).join(small_side(have), ["seed", "word"]).groupBy("seed", "identity", "h").agg(
            F.bool_or(is_open).alias("helps"),
            F.bool_and(F.col("have") + F.col("n") <= F.col("cap")).alias("fits"),
            F.collect_list(F.struct("word", "n")).alias("items"),
        )
        live = live.filter(F.col("fits") & (F.col("helps") if need_help else F.lit(True)))
        if not need_help:
            live = live.join(F.broadcast(have.filter(is_open).select("seed").distinct()), "seed", "left_semi")
        part = cap_per_group(live, ["seed"], "h", chunk, ["identity"])
        decided = checkpoint(
            part.groupBy("seed").cogroup(have.groupBy("seed")).applyInPandas(
                _fold(need_help), "seed int, identity string, h string, taken boolean"
            )
        )
        new = decided.filter("taken").select("seed", "identity")
        taken = new if taken is None else taken.unionByName(new)
        # One row per seed: where its full chunk ended. Seeds with a shorter chunk are done.
        ends = decided.groupBy("seed").agg(F.max("h").alias("end"), F.count(F.lit(1)).alias("seen"))
        going = [(r["seed"], r["end"]) for r in ends.filter(F.col("seen") == chunk).collect()]
        if not going:
            return taken
        left = reduce(or_, [(F.col("seed") == s) & (F.col("h") > end) for s, end in going])
        added = rows.join(new, ["seed", "identity"]).groupBy("seed", "word").agg(F.sum("n").alias("add"))
        have = checkpoint(
            have.join(added, ["seed", "word"], "left").select(
                "seed", "word", "target", "cap", (F.col("have") + F.coalesce("add", F.lit(0))).alias("have")
            )
        )


def fixed_test(clips: DataFrame, seeds: list[int], chunk: int = 5000, **limits) -> DataFrame:
    """Test identities per seed: visited in seeded order, kept while they help and fit."""
    counts = checkpoint(identity_counts(clips))
    return greedy_holdout(counts, test_limits(counts, **limits), seeds, "test", True, chunk)


def lock_identities(
    clips: DataFrame, seed: int, train_shots=7, val_shots=1, test_per_class=15, chunk: int = 5000
) -> DataFrame:
    """Few-shot test identities: moved while the rest still covers train and validation."""
    counts = checkpoint(identity_counts(clips))
    total = counts.groupBy("word").agg(F.sum("n").alias("total"))
    rest = F.least(F.lit(train_shots + val_shots), F.greatest(F.lit(0), F.col("total") - 1))
    limits = total.select("word", F.lit(test_per_class).cast("bigint").alias("target"), (F.col("total") - rest).alias("cap"))
    return greedy_holdout(counts, limits, [seed], "lock", False, chunk)
