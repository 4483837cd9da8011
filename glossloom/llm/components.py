"""Connected components by alternating large and small stars; nothing but two numbers a round reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import discard, stored
from glossloom.llm.shingles import Sets

#: Edges (two numbers each) up to which a single task joins them; more take rounds of shuffles.
FEW_EDGES = 50_000


def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, c) of the edges (a, b) of one task."""
    edges = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *batches])
    vertices, ends = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    joined = Sets(len(vertices))
    for i, j in ends.reshape(-1, 2).tolist():
        joined.join(i, j)
    yield pd.DataFrame({"v": vertices, "c": vertices[[joined.root(i) for i in range(len(vertices))]]} if len(vertices) else {"v": vertices, "c": vertices})


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(v, c): for every vertex of the edges (a, b) the least vertex of its component.

    Both columns are 64-bit numbers without nulls. A round connects larger
    neighbours to the least neighbour, then smaller ones; minima are combined
    before the shuffle, and a vertex with very many edges is only a skewed join key,
    which adaptive execution splits. Up to `few` edges go without rounds.
    """
    edges = edges.filter("a <> b")
    if edges.count() <= few:
        return edges.select("a", "b").coalesce(1).mapInPandas(united, "v long, c long")
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        after = stored(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a <> b").distinct(), "edges")
        row = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = after
        if (row["n"], row["h"]) == seen:
            break
        seen = (row["n"], row["h"])
    tops = now.select(F.col("b").alias("v")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(tops.select("v", F.col("v").alias("c")))
