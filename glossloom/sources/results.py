"""Run results, predictions and data manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.operators.ranking import take_last

METRICS = (
    "top1", "target_top1", "rich_top1", "target_to_rich_rate", "proto_top1", "proto_target_top1", "macro_f1", "top5",
)

RESULT_SCHEMA = (
    "run string, model string, family string, modality string, protocol string, tag string, shots int, seed int, "
    "n_words int, n_targets int, n_train bigint, n_params bigint, steps bigint, train_seconds double, gpu string, "
    "test_fingerprint string, metrics struct<"
    + ", ".join(f"{m}: double" for m in METRICS)
    + ", chance: double, n_test: bigint, per_word_top1: map<string,double>>, _corrupt string"
)


def read_results(spark: SparkSession, root: str, multi_line: bool = True, pattern: str = "result.json") -> DataFrame:
    """Readable result files below root, the newest per run; k is the shots, -1 for all.

    multi_line: one result per file; otherwise one per line.
    """
    raw = (
        spark.read.schema(RESULT_SCHEMA).option("multiLine", multi_line).option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .json(root)
    )
    rows = raw.select("*", F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_path").alias("path"))
    rows = rows.filter(F.col("_corrupt").isNull()).select(
        *[c for c in raw.columns if c not in ("metrics", "_corrupt")],
        *[F.col(f"metrics.{m}").alias(m) for m in METRICS], F.col("metrics.chance").alias("chance"), F.col("metrics.n_test").alias("n_test"),
        F.to_json("metrics.per_word_top1").alias("per_word_json"), F.coalesce("shots", F.lit(-1)).alias("k"), "mtime", "path",
    )
    latest = take_last(rows, ["run"], ["mtime", "path"])
    return latest.withColumn("per_word_top1", F.from_json("per_word_json", "map<string,double>")).drop("per_word_json")


def read_predictions(spark: SparkSession, root: str, targets: list[str]) -> DataFrame:
    """Per prediction: correctness and target flag. Class names come from the words array."""
    rows = spark.read.parquet(root)
    return rows.select(
        "tag", "model", "k", "seed", "key", (F.col("y") == F.col("pred")).alias("ok"),
        F.get("words", F.col("y")).isin(targets).alias("is_target"),
    )


def store_conflicts(manifests: DataFrame) -> DataFrame:
    """Stores whose members report different keys. manifests: (member, json)."""
    info = F.from_json("json", "map<string,struct<n_clips:bigint,n_words:bigint,keys_sha1:string>>")
    rows = manifests.select("member", F.explode(info).alias("store", "info"))
    return rows.groupBy("store").agg(
        F.count(F.lit(1)).alias("n_members"), F.count_distinct("info.keys_sha1").alias("n_fingerprints")
    )


def gather_fewshot(models: DataFrame, summary: DataFrame, metrics: DataFrame, meta: DataFrame, history: DataFrame) -> DataFrame:
    """One row per model from four optional tables.

    Best validation accuracy falls back to the history, the gap to val - test, and the
    error to the first failed draw. history: (model, epochs array<struct<val_acc>>).
    """
    rows = models
    for t in (summary, metrics, meta, history):
        rows = rows.join(t, "model", "left")
    best = F.coalesce("meta_best_val_acc", F.array_max(F.transform("epochs", lambda h: F.coalesce(h["val_acc"], F.lit(0.0)))))
    failed = F.get(F.filter("draws", lambda d: d["error"].isNotNull()), 0)["error"]
    err = F.when(F.col("test_acc").isNull(), F.coalesce("error", failed))
    return rows.select(
        "model", best.alias("best_val_acc"), "test_acc", F.coalesce("val_test_gap", best - F.col("test_acc")).alias("val_test_gap"),
        F.when(F.size("epochs") > 0, F.size("epochs")).alias("epochs_ran"), err.alias("error"),
    )
