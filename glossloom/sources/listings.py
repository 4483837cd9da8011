"""File trees, listings and CSV files of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions import text
from glossloom.functions.hashing import in_shard
from glossloom.operators.joins import match_targets, review_status


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, size, modified) of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    path = F.regexp_replace("path", r"^file:/+", "/")
    base = root.rstrip("/") + "/"
    return files.select(
        path.alias("path"), F.substring_index(path, base, -1).alias("rel"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    )


def labelled_videos(files: DataFrame, endings: tuple[str, ...] = fixed.CLIP_ENDINGS) -> DataFrame:
    """Videos with their parent folder as word; archive leftovers and files at the root are dropped."""
    parts = F.split("rel", "/")
    rows = files.filter(text.has_ending(F.col("rel"), endings) & (F.size(parts) > 1) & ~F.array_contains(parts, "__MACOSX"))
    return rows.withColumn("word", F.element_at(parts, -2))


def relabelled(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Listing rows whose folder label is wanted, with the word it stands for. wanted: (label, word)."""
    norm = wanted.select(text.normalize_gloss(F.col("label")).alias("label"), text.normalize_gloss(F.col("word")).alias("word"))
    rows = labelled_videos(files).withColumn("label", text.normalize_gloss(F.col("word"))).drop("word")
    return rows.join(norm, "label")


def dictionary_listing(files: DataFrame, vocab: DataFrame | None = None, limit: int | None = None, shard=None) -> DataFrame:
    """Citation-form clips of a dictionary: no explanations, vocabulary words only, first `limit`, one shard."""
    rows = files.filter(text.has_ending(F.col("path")) & ~F.lower("path").contains("expla"))
    rows = rows.withColumn("word", text.dictionary_word(F.col("path")))
    if vocab is not None:
        rows = rows.join(vocab, "word", "left_semi")
    if limit:
        rows = rows.orderBy("path").limit(limit)
    return rows.filter(in_shard(F.col("path"), shard))


def missing_words(vocab: DataFrame, hits: DataFrame, first: int | None = None) -> DataFrame:
    """Vocabulary words without a clip; the report shows the first ones in order."""
    rows = vocab.select("word").distinct().join(hits.select("word").distinct(), "word", "left_anti")
    return rows.orderBy("word").limit(first) if first else rows


def infer_columns(df: DataFrame, stems: DataFrame) -> tuple[str | None, str | None]:
    """(video column, word column) of a CSV of unknown shape.

    Video: the first column in which more than half of the stems are known files.
    Word: the first other column with a telling name. One unpivot and one join
    check all columns; only one row per column comes back.
    """
    cols = df.columns
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    long = long.groupBy("column", text.file_stem(F.col("value")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    known = stems.select("stem").distinct().withColumn("_k", F.lit(1))
    share = long.join(known, "stem", "left").groupBy("column").agg(
        (F.sum(F.col("n") * F.coalesce("_k", F.lit(0))) / F.sum("n")).alias("share")
    )
    hits = {r["column"] for r in share.filter(F.col("share") > 0.5).select("column").collect()}
    video = next((c for c in cols if c in hits), None)
    telling = ("word", "gloss", "label", "sign")
    word = next((c for c in cols if c != video and any(t in c.lower() for t in telling)), None)
    return video, word


def gloss_matches(rows: DataFrame, targets: DataFrame, related: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Exact gloss matches, and review candidates for targets that only have a relative.

    `related` maps a target to a gloss that is never merged into it.
    """
    normed = rows.withColumn("n", text.normalize_label(F.col("gloss")))
    matched = normed.join(targets.select(F.col("word").alias("n")), "n", "left_semi")
    lost = targets.select("word").join(matched.select(F.col("n").alias("word")).distinct(), "word", "left_anti")
    lost = lost.withColumn("n", text.map_lookup(related, F.col("word"))).filter(F.col("n").isNotNull())
    return matched, normed.join(lost.select(F.col("word").alias("target"), "n"), "n")


def spelling_variants(word: Column) -> Column:
    """Lower-case spellings under which a word may start a file name."""
    return F.array_distinct(F.array(word, F.replace(word, F.lit(" "), F.lit("_")), F.replace(word, F.lit(" "), F.lit(""))))


def first_stem(path: Column) -> Column:
    name = text.file_name(path)
    return F.when(name.contains("__"), F.element_at(F.split(name, "__"), 1)).otherwise(F.element_at(F.split(name, "_"), 1))


def filename_matches(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(word, path): the file name starts with a spelling of the word, or normalises to it."""
    stem = first_stem(F.col("path"))
    forms = F.array_distinct(F.array(F.lower(stem), text.normalize_label(stem)))
    names = files.select("path", F.explode(forms).alias("form"))
    wanted = targets.select("word", F.explode(spelling_variants(F.lower("word"))).alias("form"))
    return names.join(wanted, "form").select("word", "path").distinct()


def needed_categories(meta: DataFrame, targets: DataFrame) -> DataFrame:
    """Categories that hold at least one target word. meta: (label, parent_label)."""
    clean = meta.withColumn("word", text.normalize_label(text.strip_index(F.col("label"))))
    return clean.join(targets.select("word"), "word", "left_semi").select("parent_label").distinct()


def rescan(files: DataFrame, targets: DataFrame, dataset: str) -> DataFrame:
    """Local files of one source as matched records with review status."""
    labelled = files.withColumn("original_label", text.label_from_path(F.col("path")))
    bridged = text.map_lookup(fixed.REVIEW_ALIASES, F.col("original_label"))
    rows = match_targets(labelled, F.col("original_label"), targets)
    known = targets.select(F.col("word").alias("_alias"))
    rows = rows.withColumn("_alias", F.when(F.col("target").isNull(), bridged)).join(known.withColumn("_ok", F.lit(True)), "_alias", "left")
    word = F.coalesce("target", F.when(F.col("_ok"), F.col("_alias")))
    return rows.withColumn("word", word).filter(F.col("word").isNotNull()).select(
        "word", F.col("word").alias("normalized_word"), F.lit(dataset).alias("dataset"), "original_label",
        F.col("path").alias("video_path"), text.file_name(F.col("path")).alias("original_filename"),
        review_status(F.col("match"), F.col("original_label")).alias("review_status"),
    )
