"""Exact ranks inside groups of any size.

A plain row_number() sorts each group in one task. Here a group is cut into
ordered buckets first; bucket sizes (pre-aggregated before the shuffle) give
every bucket its offset, and only buckets are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossloom.session import checkpoint


def _ranked(df: DataFrame, by: list[str], bucket: str, order: list[Column], out: str, total: str | None) -> DataFrame:
    sizes = df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if total:
        cols.append(F.sum("_n").over(Window.partitionBy(*by)).alias(total))
    offsets = sizes.select(*by, bucket, *cols)
    local = df.withColumn("_in_bucket", F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)))
    return (
        local.join(offsets, [*by, bucket])
        .withColumn(out, (F.col("_in_bucket") + F.col("_off")).cast("bigint"))
        .drop("_in_bucket", "_off", bucket)
    )


def hash_rank(
    df: DataFrame, by: list[str], hash_col: str, out: str = "rank", ties: list[str] | None = None,
    total: str | None = None, digits: int = 3,
) -> DataFrame:
    """Rank by a hex hash inside each group of non-null keys; buckets are hash prefixes."""
    ties = ties or []
    bucketed = df.withColumn("_bucket", F.substring(hash_col, 1, digits))
    return _ranked(bucketed, by, "_bucket", [F.col(hash_col), *[F.col(t) for t in ties]], out, total)


def time_rank(
    df: DataFrame, by: list[str], ts: str, ties: list[str], out: str = "pos",
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """Rank by a timestamp inside each group; buckets are equal spans of time.

    The span follows from one small aggregate (count, min, max), so that a
    bucket holds about rows_per_bucket rows even if one group has most of them.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min(seconds), F.max(seconds)).first()
    buckets = max(1, -(-n // rows_per_bucket))
    width = max(((hi or 0.0) - (lo or 0.0)) / buckets, 1e-6)
    bucketed = df.withColumn("_bucket", F.floor((seconds - F.lit(lo or 0.0)) / F.lit(width)))
    return _ranked(bucketed, by, "_bucket", [F.col(ts), *[F.col(t) for t in ties]], out, None)


def range_rank(df: DataFrame, by: list[str], order: list[Column], out: str = "rank", total: str | None = None) -> DataFrame:
    """Rank under any total order; buckets are sampled key ranges.

    The range-partitioned rows are checkpointed, so the two uses of the bucket
    number see the same partitions even when executors are lost.
    """
    keys = [F.col(b) for b in by]
    cut = df.repartitionByRange(*keys, *order).withColumn("_bucket", F.spark_partition_id())
    return _ranked(checkpoint(cut), by, "_bucket", order, out, total)


def median(df: DataFrame, by: list[str], value: Column, out: str = "median") -> DataFrame:
    """Exact median per group of any size: the middle one or two values by range rank."""
    rows = df.select(*by, value.alias("_v")).filter(F.col("_v").isNotNull())
    ranked = range_rank(rows, by, [F.col("_v")], "_rank", "_n")
    middle = (F.col("_rank") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_rank") == F.floor((F.col("_n") + 2) / 2))
    return ranked.filter(middle).groupBy(*by).agg(F.avg("_v").alias(out))


def take_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First row of each group under a total order; map-side combine, no sort."""
    rest = [c for c in df.columns if c not in by and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*by).agg(best).select(*by, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]])


def take_last(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Last row of each group under a total order; map-side combine, no sort."""
    rest = [c for c in df.columns if c not in by and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*by).agg(best).select(*by, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]])


def cap_per_group(df: DataFrame, by: list[str], hash_col: str, k: int, ties: list[str] | None = None) -> DataFrame:
    """The k first rows of each group in hash order.

    Ranges by two digits of the hash keep their own k first, then ranges by one
    digit, then the group, so a task sees at most 16 k rows of a hot group after
    the first cut, however large the group is.
    """
    order = [hash_col, *(ties or [])]
    for digits in (2, 1, 0):
        window = Window.partitionBy(*by, *[F.substring(hash_col, 1, digits)] * bool(digits)).orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= k).drop("_r")
    return df
