"""Clip indexes, corpus metadata and multi-store clip tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossloom import fixed
from glossloom.functions import text
from glossloom.operators.dedup import clip_uid, keep_first_store
from glossloom.operators.sessions import fill_sessions


def strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_text_csv(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """CSV with a header, every column a string, empty text kept as empty."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    df = reader.schema(strings(columns)).csv(path) if columns else reader.csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def usable(index: DataFrame) -> DataFrame:
    """Frame count as integer (bad text becomes 0); clips without frames are dropped."""
    frames = F.coalesce(F.col("n_frames").cast("string").try_cast("double").cast("int"), F.lit(0))
    return index.withColumn("n_frames", frames).filter(F.col("n_frames") > 0)


def read_index(spark: SparkSession, store: str, layout: str | None = None) -> DataFrame:
    """Clip index of a store; a wrong layout tag is an error."""
    if layout is not None and layout != fixed.LAYOUT_TAG:
        raise ValueError(f"{store}: layout {layout!r}, expected {fixed.LAYOUT_TAG!r}")
    rows = usable(read_text_csv(spark, f"{store}/index.csv", fixed.INDEX_COLUMNS))
    return rows.withColumn("store", F.lit(store)).withColumn("abs_path", F.concat(F.lit(f"{store}/"), "path"))


def read_layout(spark: SparkSession, store: str) -> str:
    return spark.read.option("multiLine", True).schema("layout string").json(f"{store}/store.json").first()[0]


def load_stores(
    stores: list[DataFrame], counter_source: str = fixed.COUNTER_SOURCE, gap: int = fixed.SESSION_GAP,
    sources: list[str] | None = None, words: list[str] | None = None, dedup: bool = True,
) -> DataFrame:
    """Clip table of several stores with canonical words, sessions and identities.

    Order matters: filters, then the first copy of a clip in store order, then the
    sessions over all remaining clips of the counter source, then identities.
    """
    df = None
    for i, s in enumerate(stores):
        part = s.withColumn("_store", F.lit(i))
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    df = df.withColumn("word", text.normalize_gloss(F.col("word")))
    if sources:
        df = df.filter(F.col("source").isin(sources))
    if words:
        wanted = df.sparkSession.createDataFrame([(w,) for w in words], "word string")
        df = df.join(F.broadcast(wanted.select(text.normalize_gloss(F.col("word")).alias("word")).distinct()), "word", "left_semi")
    counter = F.when(F.col("source") == counter_source, text.clip_counter(F.col("video_rel")))
    df = df.withColumn("mvi", counter)
    if dedup:
        df = keep_first_store(df, clip_uid(counter_source, F.col("mvi")), ["_store", "key"])
    df = fill_sessions(df, counter_source, F.col("mvi"), gap)
    ident = text.identity_key(F.col("signer"), F.col("session"), F.col("source"), F.col("key"))
    return df.withColumn("identity", ident).drop("_store")


def total_order(clips: DataFrame) -> DataFrame:
    return clips.orderBy("word", "source", "key")


def read_metadata(spark: SparkSession, path: str, dataset_dir: str, min_clips: int = 1) -> DataFrame:
    """Corpus metadata with portable paths, words with at least min_clips rows."""
    df = read_text_csv(spark, path).withColumn("video_path", text.corpus_relative(F.col("video_path")))
    keep = df.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_clips).select("word")
    return df.join(keep, "word", "left_semi").withColumn("abs_path", F.concat(F.lit(f"{dataset_dir}/"), "video_path"))


def corpus_to_clips(meta: DataFrame) -> DataFrame:
    """Corpus rows as clip rows: only real signer ids, one signer for the dictionary, sessions of one source."""
    rel = text.corpus_relative(F.col("video_path"))
    ds, sg = F.col("dataset"), F.col("signer")
    tag = F.regexp_extract(rel, r"session(\d+)", 1)
    signer = F.when(ds.startswith(fixed.DICTIONARY_SOURCE), fixed.DICTIONARY_SIGNER).when(sg.rlike(r"^(User\d+|team_\w+)$"), sg).otherwise("")
    session = F.when((ds == fixed.SESSION_SOURCE) & (tag != ""), F.concat(F.lit(f"{fixed.SESSION_SOURCE.lower()}_s"), tag)).otherwise("")
    return meta.select(
        rel.alias("video_rel"), "word", F.lower(ds).alias("source"), signer.alias("signer"), session.alias("session"), "license"
    )


def quality_score(width: Column, height: Column, fps: Column, duration: Column, brightness: Column, ok: Column) -> Column:
    """Stepwise penalties on probed media values, 0 for unreadable clips."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    side = F.least(z(width), z(height))
    dec = lambda v: F.lit(v).cast("decimal(4,2)")
    none = dec("0")
    penalty = (
        F.when(side < 224, dec("0.4")).when(side < 360, dec("0.15")).otherwise(none)
        + F.when(z(fps) < 12, dec("0.3")).when(z(fps) < 20, dec("0.1")).otherwise(none)
        + F.when((z(duration) < 0.3) | (z(duration) > 30), dec("0.4")).otherwise(none)
        + F.when(brightness.isNotNull() & ((brightness < 20) | (brightness > 235)), dec("0.2")).otherwise(none)
    )
    score = F.greatest(F.lit(0.0), (dec("1") - penalty).cast("double"))
    return F.when(F.coalesce(ok, F.lit(False)), score).otherwise(F.lit(0.0))


def vocabulary(stores: list[DataFrame]) -> DataFrame:
    """Distinct canonical words of several stores."""
    words = None
    for s in stores:
        part = s.select(text.normalize_gloss(F.col("word")).alias("word")).distinct()
        words = part if words is None else words.unionByName(part)
    return words.distinct()


def target_words(df: DataFrame) -> DataFrame:
    """Word list (words array) as ordered-unique normalised words with their first position."""
    rows = df.select(F.posexplode("words").alias("pos", "raw")).withColumn("word", text.normalize_label(F.col("raw")))
    return rows.filter(F.col("word") != "").groupBy("word").agg(F.min("pos").alias("pos"))
