"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossloom.llm.common import WORD, if_small, stored, text_or_empty
from glossloom.operators.ranking import range_rank

WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix-1"
#: Hex digits by which a search for the cut narrows: 4,096 buckets a source, twice.
STEP, STEPS = 3, 2


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _key(source: str) -> Column:
    """The source as a join key that a null has too."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def _order(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """target per source: by weight, but at most epochs times its size; what is cut off goes to the others by weight.

    sources has _source, _size and _weight. Every round clamps all sources above
    their cap at once and reads back two sums; clamped sources stay clamped, so
    the rounds end.
    """
    total = sources.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).first()["n"]
    cap = F.col("_size") * F.lit(float(epochs))
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else cap < F.col("_weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(F.lit(0.0))).alias("given"), F.sum(F.when(over, F.lit(0.0)).otherwise(F.col("_weight"))).alias("weight"),
            F.count_if(over).alias("clamped"),
        ).first()
        if row["clamped"] == clamped or not row["weight"]:
            break
        clamped = row["clamped"]
        level = (share * total - row["given"]) / row["weight"]
    return sources.withColumn("_target", F.least(cap, F.col("_weight") * F.lit(0.0 if level is None else level)))


def _cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """_cut per source: documents whose order key is below it make up the fractional repetition.

    Units (documents of one key) are taken in key order while their middle lies
    within the wanted words, so the error is at most half a unit. The unit is found
    through bucket sums of ever longer key prefixes; no source is sorted as a whole.
    """
    at = stored(sources.select("_source", F.col("_want"), F.lit(0).cast("double").alias("_before"), F.lit("").alias("_prefix")), "cuts")
    by = Window.partitionBy("_source")
    for step in range(1, STEPS + 1):
        inside = sized.join(if_small(at), "_source").filter(F.col("_order").startswith(F.col("_prefix")))
        sums = inside.groupBy("_source", F.substring("_order", 1, step * STEP).alias("_next"), "_want", "_before").agg(F.sum("_size").alias("_n"))
        start = F.col("_before") + F.coalesce(F.sum("_n").over(by.orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = sums.withColumn("_start", start).filter(F.col("_start") <= F.col("_want")).groupBy("_source").agg(F.max(F.struct("_next", "_start", "_want")).alias("_m"))
        at = stored(last.select("_source", F.col("_m._want").alias("_want"), F.col("_m._start").cast("double").alias("_before"), F.col("_m._next").alias("_prefix")), "cuts")
    units = sized.join(if_small(at), "_source").filter(F.col("_order").startswith(F.col("_prefix"))).groupBy("_source", "_order", "_want", "_before", "_prefix").agg(F.sum("_size").alias("_n"))
    start = F.col("_before") + F.coalesce(F.sum("_n").over(by.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    beyond = F.when(start + F.col("_n") / 2 > F.col("_want"), F.col("_order"))
    # 'g' follows every hex digit: all units of the last bucket are taken
    return units.withColumn("_beyond", beyond).groupBy("_source").agg(F.coalesce(F.min("_beyond"), F.concat(F.first("_prefix"), F.lit("g"))).alias("_cut"))


def mix_plan(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): a narrow row per document, and per source its size, target, whole repetitions and cut."""
    sized = stored(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_name"), _key(source).alias("_source"), _order(doc_id, seed).alias("_order"), words(text_or_empty(text)).alias("_size")), "sizes")
    sources = sized.groupBy("_source", "_name").agg(F.sum("_size").alias("_size"))
    # null last, else code points: the byte order of UTF-8
    ranked = range_rank(sources, [], [F.col("_name").isNull().alias("_null"), F.col("_name")], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = stored(water_fill(stored(ranked.select("_source", "_name", "_size", weight.alias("_weight")), "sources"), share, epochs), "targets")
    whole = F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(F.lit(0)).cast("long")
    planned = filled.withColumn("_whole", whole).withColumn("_want", F.col("_target") - F.col("_whole") * F.col("_size"))
    partial = planned.filter(F.col("_want") > 0)
    plan = planned.join(_cuts(sized, partial), "_source", "left").select("_source", F.col("_size").alias("_source_size"), "_target", "_whole", F.coalesce("_cut", F.lit("")).alias("_cut"))
    return sized, stored(plan, "plan")


def _copies() -> Column:
    return F.col("_whole") + (F.col("_order") < F.col("_cut")).cast("long")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row, see mix_plan for the settings.

    Null texts have size 0; null is a source of its own, the last one. Rows that
    repeat one doc_id are taken together or not at all; a source without words has
    target 0. Other columns are ignored. An empty table gives no rows.
    """
    sized, plan = mix_plan(docs, text, source, doc_id, **how)
    joined = sized.join(if_small(plan), "_source")
    return joined.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * _copies()).alias("taken")
    )


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED, **how) -> DataFrame:
    """The columns of docs, each row as often as the mix takes it. Whole texts stay where they are: only the plan moves."""
    _, plan = mix_plan(docs, text, source, doc_id, seed=seed, **how)
    keyed = docs.select(F.struct("*").alias("_row"), _key(source).alias("_source"), _order(doc_id, seed).alias("_order"))
    times = keyed.join(if_small(plan), "_source").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(_copies(), F.lit(1)))).alias("_k"), _copies().alias("_n"))
    return times.filter(F.col("_n") > 0).select("_row.*")


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *,
        ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
          / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
v AS (SELECT coalesce(arg_min(level, cap / weight) FILTER (WHERE cap >= weight * level), 1e300::DOUBLE) AS level FROM l),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM v)) AS target FROM w),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.o, d.source,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
