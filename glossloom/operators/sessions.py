"""Gap sessions and backward as-of joins over integer counters.

Distinct counters are cut into number ranges of a fixed width. A range holds at
most `width` counters, so a source with most of the rows is spread over many
tasks; a small per-range summary carries the state across range borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossloom import fixed

WIDTH = 1_000_000


def gap_sessions(df: DataFrame, by: list[str], counter: str, gap: int = fixed.SESSION_GAP, width: int = WIDTH) -> DataFrame:
    """Distinct (by, counter) with the first counter of its session.

    A new session starts where the counter jumps by more than gap.
    """
    nums = (
        df.filter(F.col(counter).isNotNull())
        .select(*by, F.col(counter).cast("bigint").alias(counter))
        .distinct()
        .withColumn("_b", F.floor(F.col(counter) / F.lit(width)))
    )
    in_range = Window.partitionBy(*by, "_b").orderBy(counter)
    across = Window.partitionBy(*by).orderBy("_b")
    edges = nums.groupBy(*by, "_b").agg(F.max(counter).alias("_hi"))
    edges = edges.select(*by, "_b", F.lag("_hi").over(across).alias("_prev_hi"))
    flagged = nums.withColumn("_prev", F.lag(counter).over(in_range)).join(edges, [*by, "_b"])
    flagged = flagged.withColumn("_prev", F.coalesce("_prev", "_prev_hi"))
    is_start = F.col("_prev").isNull() | (F.col(counter) - F.col("_prev") > gap)
    flagged = flagged.withColumn("_start", F.when(is_start, F.col(counter)))
    last = flagged.groupBy(*by, "_b").agg(F.max("_start").alias("_s"))
    carry = last.select(
        *by, "_b", F.max("_s").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry")
    )
    running = F.max("_start").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    return (
        flagged.withColumn("_run", running)
        .join(carry, [*by, "_b"])
        .select(*by, counter, F.coalesce("_run", "_carry").alias("session_start"))
    )


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], number: str, start: str, width: int = WIDTH
) -> DataFrame:
    """Adds the greatest right.start <= left.number of the same group (null if none)."""
    points = left.filter(F.col(number).isNotNull()).select(*by, F.col(number).cast("bigint").alias("_at")).distinct()
    starts = right.select(*by, F.col(start).cast("bigint").alias("_at")).distinct()
    both = points.withColumn("_st", F.lit(None).cast("bigint")).unionByName(starts.withColumn("_st", F.col("_at")))
    both = both.withColumn("_b", F.floor(F.col("_at") / F.lit(width)))
    across = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy(*by, "_b").agg(F.max("_st").alias("_m"))
    carry = carry.select(*by, "_b", F.max("_m").over(across).alias("_carry"))
    upto = Window.partitionBy(*by, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    found = (
        both.withColumn("_in", F.max("_st").over(upto))
        .filter(F.col("_st").isNull())
        .join(carry, [*by, "_b"])
        .select(*by, F.col("_at").alias(number), F.coalesce("_in", "_carry").alias(start))
    )
    return left.withColumn(number, F.col(number).cast("bigint")).join(found, [*by, number], "left")


def fill_sessions(df: DataFrame, source: str, counter: Column, gap: int = fixed.SESSION_GAP, width: int = WIDTH) -> DataFrame:
    """Writes the session of clips of one source that have a counter and no session.

    Only those clips are shuffled; all others pass by.
    """
    blank = F.trim(F.coalesce(F.col("session"), F.lit(""))) == ""
    number = F.when(F.col("source") == source, counter).cast("bigint")
    numbered = df.withColumn("_n", number)
    has = F.col("_n").isNotNull()
    sess = gap_sessions(numbered.filter(has), [], "_n", gap, width)
    label = F.concat(F.lit(f"{source}_s"), F.col("session_start").cast("string"))
    named = numbered.filter(has & blank).join(sess, "_n", "left").withColumn("session", F.coalesce(label, F.col("session")))
    rest = numbered.filter(~(has & blank))
    return rest.select(*df.columns).unionByName(named.select(*df.columns))
