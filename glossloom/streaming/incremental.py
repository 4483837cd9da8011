"""Incremental ingest on Structured Streaming.

Every function starts a query and returns it. Checkpoints live in the shared
folder, batches are written under their id, so a restarted or repeated batch
replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossloom.operators.ranking import take_first
from glossloom.sources.sinks import append_batch


def read_stream(spark, path: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
        .option("latestFirst", False).parquet(path)
    )


def watch_files(spark, folder: str, expected: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """New files of a folder: complete ones to `good`, wrong sizes to `bad` (file name, size, expected)."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True).load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("key"), F.col("length").alias("disk_size"))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.join(expected, "key").withColumn("complete", F.col("disk_size") == F.col("size"))
        rows.filter("complete").drop("complete").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        rows.filter(~F.col("complete")).drop("complete").write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Index rows appended batch by batch; readers take the last row of a key."""
    return (
        rows.writeStream.foreachBatch(lambda batch, i: append_batch(batch, table, i))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_dedup(rows: DataFrame, content: Column, order: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """First record of every content hash over all batches, kept in a ledger table.

    The ledger holds hashes, not contents; a batch is compared with earlier batches
    only, so that its repetition gives the same rows. Where files do not arrive by
    `order`, a hash has a further row for every smaller order value of a later
    batch; the least one is the first record. Null contents are equal.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        first = take_first(batch.select(F.sha2(content, 256).alias("sha256"), order), ["sha256"], [order])
        if batch_id > 0:
            schema = "sha256 string, " + f"{order} {dict(batch.dtypes)[order]}"
            seen = batch.sparkSession.read.schema(schema + ", batch bigint").option("basePath", ledger).parquet(ledger)
            seen = seen.filter(F.col("batch") < batch_id).select(F.col("sha256").alias("_sha"), F.col(order).alias("_o"))
            first = first.join(seen, F.col("sha256").eqNullSafe(F.col("_sha")) & (F.col("_o") <= F.col(order)), "left_anti")
        first.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_recent(rows: DataFrame, content: Column, ts: str, delay: str) -> DataFrame:
    """Exact duplicates dropped while both arrive within the delay; state is bounded by it."""
    return rows.withWatermark(ts, delay).withColumn("sha256", F.sha2(content, 256)).dropDuplicatesWithinWatermark(["sha256"])


def stream_sessions(rows: DataFrame, ts: str, by: list[str], gap: str, delay: str) -> DataFrame:
    """Gap sessions per key, emitted once the watermark has passed them."""
    window = F.session_window(ts, gap)
    out = rows.withWatermark(ts, delay).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    return out.select(*by, F.col("w.start").alias("session_start"), "last", "n")


def write_append(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").outputMode("append").option("path", table).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
