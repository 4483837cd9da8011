"""Queries that run a stream to its end, or write and read a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossloom.operators.sessions import gap_sessions
from glossloom.plans import views
from glossloom.plans.registry import query
from glossloom.plans.views import with_views
from glossloom.session import work_path
from glossloom.sources import clips as clip_sources
from glossloom.sources import results, sinks
from glossloom.streaming import incremental


def _table_stream(spark, d, name):
    """A table as a stream of its files; the pattern in the path matches one file as well as a folder of them."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return incremental.read_stream(spark, f"{d}/{{{name}.parquet}}", schema, "*")


def _event_stream(spark, d):
    return _table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_sessions", """
    WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS last, count(*) AS n FROM s GROUP BY user_id, s
    HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sessions(spark, d):
    """Sessions the watermark has closed by the end of the input."""
    out, state = work_path(spark, "sessions"), work_path(spark, "state")
    sessions = incremental.stream_sessions(_event_stream(spark, d), "ts", ["user_id"], "2 hours", "10 minutes")
    incremental.write_append(sessions, out, state).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("last").alias("last"), "n")


@query("stream_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY text")
def stream_dedup(spark, d):
    docs = _table_stream(spark, d, "documents").select("doc_id", "text")
    ledger = work_path(spark, "ledger")
    incremental.stream_dedup(docs, F.col("text"), "doc_id", ledger, work_path(spark, "state")).awaitTermination()
    return spark.read.parquet(ledger).groupBy("sha256").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sha256")


@query("stream_dedup_recent", "SELECT DISTINCT sha256(props) AS sha256 FROM events")
def stream_dedup_recent(spark, d):
    """Distinct contents while duplicates arrive within the watermark."""
    out = work_path(spark, "recent")
    rows = incremental.dedup_recent(_event_stream(spark, d).select("ts", "props"), F.col("props"), "ts", "60 days")
    incremental.write_append(rows, out, work_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("sha256")


@query("stream_upsert", with_views("clips", body="SELECT key, word, source, CAST(n_frames AS VARCHAR) AS n_frames FROM clips"))
def stream_upsert(spark, d):
    index = work_path(spark, "index")
    rows = _event_stream(spark, d).select(
        F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("word"),
        F.element_at(F.array(F.lit("studio"), F.lit("camera"), F.lit("web"), F.lit("dictionary")), F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(4)) + 1).alias("source"),
        F.floor("value").alias("n_frames"),
    )
    incremental.stream_upsert(rows, index, work_path(spark, "state")).awaitTermination()
    return sinks.read_latest(spark, index).select("key", "word", "source", "n_frames")


@query("index_append", with_views("clips", body="""
    SELECT key, word, CASE WHEN source = 'studio' THEN 'relabelled' ELSE source END AS source FROM clips"""))
def index_append(spark, d):
    """Two batches into one index, the second rewriting some keys, then compaction."""
    index = work_path(spark, "index")
    rows = views.clips(spark, d)
    sinks.append_batch(rows, index, 0)
    sinks.append_batch(rows.filter(F.col("source") == "studio").withColumn("source", F.lit("relabelled")), index, 1)
    return sinks.read_latest(spark, sinks.compact(spark, index)).select("key", "word", "source")


@query("index_scan", with_views("clips", body="""
    SELECT key, word, source, n_frames FROM clips WHERE n_frames > 0"""))
def index_scan(spark, d):
    """A clip index written as CSV and read back: text columns, frame count cast, empty clips dropped."""
    store = work_path(spark, "store")
    sinks.write_csv(sinks.index_rows(views.clips(spark, d)), f"{store}/index.csv")
    return clip_sources.read_index(spark, store).select("key", "word", "source", "n_frames")


@query("metadata_scan", with_views("clips", body="""
    SELECT video_rel AS video_path, '/data/' || video_rel AS abs_path, word || ' ' || k AS word FROM clips
    WHERE word || ' ' || k IN (SELECT word || ' ' || k FROM clips GROUP BY 1 HAVING count(*) >= 20)"""))
def metadata_scan(spark, d):
    out = work_path(spark, "metadata")
    rows = views.clips(spark, d).select(
        F.concat_ws(" ", "word", F.col("k").cast("string")).alias("word"),
        F.concat(F.lit("C:\\work\\ISL_DATASET_40\\"), F.replace("video_rel", F.lit("/"), F.lit("\\"))).alias("video_path"),
    )
    sinks.write_records(rows, out)
    return clip_sources.read_metadata(spark, out, "/data", 20).select("video_path", "abs_path", "word")


@query("result_files", with_views("preds", body="""
    , m AS (SELECT tag, k, seed, model, avg(CAST(y = pred AS INT)) AS top1 FROM preds GROUP BY ALL)
    SELECT tag || '/' || model || '/K' || k || '/s' || seed AS run, CAST(k AS INTEGER) AS k, round(top1, 9) AS top1 FROM m"""))
def result_files(spark, d):
    """Run results written as JSON lines and read back with the nested schema."""
    out = work_path(spark, "runs")
    ok = F.avg((F.col("y") == F.col("pred")).cast("int"))
    runs = views.predictions(spark, d).groupBy("tag", "k", "seed", "model").agg(ok.alias("top1"))
    name = F.concat_ws("/", "tag", "model", F.concat(F.lit("K"), F.col("k").cast("string")), F.concat(F.lit("s"), F.col("seed").cast("string")))
    body = runs.select(
        name.alias("run"), "model", "tag", F.col("k").alias("shots"), "seed",
        F.struct("top1", F.lit(float("nan")).alias("proto_top1")).alias("metrics"),
    )
    body.write.json(out)
    read = results.read_results(spark, out, multi_line=False, pattern="*.json")
    return read.select("run", "k", F.round("top1", 9).alias("top1"))


@query("publish_check", with_views("clips", body="""
    SELECT video_rel AS video_path, word FROM clips WHERE video_rel NOT IN (SELECT video_rel FROM clips WHERE source <> 'web')"""))
def publish_check(spark, d):
    rows = views.clips(spark, d).select(F.col("video_rel").alias("video_path"), "word", "source")
    return sinks.publish_check(rows.drop("source"), rows.filter(F.col("source") != "web"))


@query("batch_sessions", """
    WITH g AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    s AS (SELECT user_id, sec, max(CASE WHEN gap IS NULL OR gap > 7200 THEN sec END) OVER (PARTITION BY user_id ORDER BY sec) AS st FROM g)
    SELECT user_id, st AS session_start, max(sec) AS last FROM s GROUP BY ALL""")
def batch_sessions(spark, d):
    """All sessions of a finished input, open ones included."""
    ev = views.table(spark, d, "events", "user_id", "ts").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))
    rows = gap_sessions(ev, ["user_id"], "sec", 7200, 86_400)
    return rows.groupBy("user_id", "session_start").agg(F.max("sec").alias("last"))
