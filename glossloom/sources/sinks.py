"""Tables and reports on a shared file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.operators.ranking import take_last
from glossloom.session import work_path


def index_rows(df: DataFrame) -> DataFrame:
    """Index columns as strings, absent ones empty."""
    have = set(df.columns)
    return df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in fixed.INDEX_COLUMNS]
    )


def append_batch(df: DataFrame, table: str, batch: int) -> None:
    """Writes one batch of an index. Writing the same batch again replaces it."""
    (
        index_rows(df).withColumn("batch", F.lit(batch).cast("bigint")).withColumn("pos", F.monotonically_increasing_id())
        .write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={batch}")
    )


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """Current state of an index: the last written row of every key."""
    rows = spark.read.option("basePath", table).parquet(f"{table.rstrip('/')}/batch=*")
    rows = rows.withColumn("batch", F.col("batch").cast("bigint"))
    return take_last(rows, ["key"], ["batch", "pos"]).select(*fixed.INDEX_COLUMNS)


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Old and new rows, the last per key; columns missing on one side are empty."""
    both = old.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    return take_last(both, [key], ["_b"]).drop("_b")


def merge_stores(stores: list[DataFrame]) -> DataFrame:
    """Several indexes as one; a later store wins on the same key."""
    rows = None
    for i, s in enumerate(stores):
        part = s.withColumn("_b", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return take_last(rows, ["key"], ["_b"]).drop("_b")


def new_log_entries(src: DataFrame, dst: DataFrame, on: str) -> DataFrame:
    """Done-log entries the destination does not have yet."""
    return src.select(on).distinct().join(dst.select(on), on, "left_anti")


def compact(spark: SparkSession, table: str) -> str:
    """Writes the current state into a fresh table and returns its path."""
    out = work_path(spark, "index")
    read_latest(spark, table).withColumn("batch", F.lit(0).cast("bigint")).withColumn(
        "pos", F.monotonically_increasing_id()
    ).write.partitionBy("batch").parquet(out)
    return out


def manifest(store: DataFrame, fingerprint: DataFrame, by: list[str], **extra) -> DataFrame:
    """Completion manifest: counts, fingerprint, extras and the finishing time. Empty stores have none."""
    sizes = store.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clips"), F.count_distinct("word").alias("n_words"))
    out = sizes.join(fingerprint.select(*by, F.col("fingerprint").alias("keys_sha1")), by)
    for name, value in extra.items():
        out = out.withColumn(name, F.lit(value))
    return out.withColumn("finished", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def manifest_matches(manifests: DataFrame, wanted: dict) -> DataFrame:
    """Manifests whose pinned options equal the wanted ones; null options are ignored.

    Values are compared in a canonical text form, so a list compares by its content.
    """
    out = manifests
    for name, value in wanted.items():
        if value is not None:
            out = out.filter(F.to_json(F.struct(F.col(name).alias("v"))).eqNullSafe(F.to_json(F.struct(F.lit(value).alias("v")))))
    return out


def record_rows(df: DataFrame) -> DataFrame:
    """Corpus record: 20 string columns in fixed order."""
    have = set(df.columns)
    return df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in fixed.RECORD_COLUMNS]
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    write_csv(record_rows(df), path)


def provenance(records: DataFrame) -> DataFrame:
    """Per record: sorted-key JSON of the whole row."""
    cols = sorted(records.columns)
    return records.select("video_path", F.to_json(F.struct(*cols)).alias("json"))


def publish_check(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata rows whose file is absent; a publishable table has none."""
    return metadata.join(files.select("video_path").distinct(), "video_path", "left_anti")


def write_run(preds: DataFrame, metrics: DataFrame, path: str) -> None:
    """Predictions by tag and model, metrics as JSON lines; the commit protocol makes both atomic."""
    preds.write.mode("overwrite").partitionBy("tag", "model").parquet(f"{path}/preds")
    metrics.write.mode("overwrite").json(f"{path}/results")


def split_good_and_failed(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the (path, error) log of the others; the job goes on."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull()).select("path", error)
