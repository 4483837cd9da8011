"""The given tables in the shapes the operators expect, and the same views in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions import text
from glossloom.functions.hashing import average_hash, seeded_order
from glossloom.operators import series
from glossloom.operators.ranking import hash_rank
from glossloom.operators.score import nearest_prototype, prototypes
from glossloom.operators.sessions import fill_sessions
from glossloom.plans.registry import shared
from glossloom.session import spread

CLIP_FRAMES = 64
GAP = 12
SEEDS = (0, 1, 2)
SHOTS = (1, 2, 4, 8)
TARGETS = ("click", "view")
TARGET_LABELS = (0, 1, 2)
MODELS = {"dim16": 16, "dim64": 64}
CLIP_POINT_FRAMES = 8
#: Clips of points (about 100 KB each) made at once, and made by one task.
POINT_ROWS, POINT_TASK = 64, 2_000
_SPOTS = (3 * np.arange(fixed.N_POINTS)[:, None] + 8 * np.arange(CLIP_POINT_FRAMES)[:, None, None] + np.arange(3)) % 64
_HAND = (np.arange(fixed.N_POINTS) >= 33) & (np.arange(fixed.N_POINTS) < 75)


def fingerprint_sql(key: str, where: str = "TRUE") -> str:
    """SQL of hashing.key_fingerprint over the rows of a group that satisfy a condition."""
    n = f"count(*) FILTER (WHERE {where})"
    part = lambda cut: f"CAST(sum(CAST('0x' || sha1({key}){cut} AS BIGINT)) FILTER (WHERE {where}) AS VARCHAR)"
    return f"CASE WHEN {n} > 0 THEN sha1({n} || '|' || {part('[1:15]')} || '|' || {part('[16:30]')})[1:12] END"


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def events(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props").withColumn("k", k)


def clips(spark: SparkSession, d: str) -> DataFrame:
    """events as a clip index: four sources with their own signer conventions."""
    kind = F.pmod("k", F.lit(4))
    source = F.when(kind == 0, "studio").when(kind == 1, "camera").when(kind == 2, "web").otherwise("dictionary")
    user = F.col("user_id").cast("string")
    key = F.col("event_id").cast("string")
    return events(spark, d).select(
        key.alias("key"), F.col("event_type").alias("word"), source.alias("source"),
        F.when(kind == 0, F.concat(F.lit("User"), user)).when(kind == 1, "").when(kind == 2, "unknown").otherwise("islrtc").alias("signer"),
        F.lit("").alias("session"), F.floor("value").cast("int").alias("n_frames"),
        F.concat("event_type", F.when(kind == 1, F.lit("/MVI_")).otherwise(F.lit("/clip_")), key, F.lit(".mp4")).alias("video_rel"),
        F.concat(F.lit("licence "), F.pmod("k", F.lit(3)).cast("string")).alias("license"), "user_id", "k",
    )


def _identified(spark: SparkSession, d: str) -> DataFrame:
    counter = text.clip_counter(F.col("video_rel"))
    with_sessions = fill_sessions(clips(spark, d), "camera", counter, GAP)
    ident = text.identity_key(F.col("signer"), F.col("session"), F.col("source"), F.col("key"))
    return with_sessions.withColumn("identity", ident)


def identified(spark: SparkSession, d: str) -> DataFrame:
    """Clips with camera sessions and identities, the clip table that reports and splits share."""
    return shared(spark, d, "identified", _identified)


def series_rows(spark: SparkSession, d: str) -> DataFrame:
    """events as one whole series of frames per user."""
    return series.ordered(events(spark, d).drop("props", "event_type"), ["user_id"], "ts", ["event_id"])


def frames(spark: SparkSession, d: str) -> DataFrame:
    """events as frames of bounded clips per user."""
    return series.cut_clips(events(spark, d).drop("props", "event_type"), ["user_id"], "ts", ["event_id"], CLIP_FRAMES)


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vec")
    )


ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ."


def _document_hashes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents", "doc_id", "lang", "source", "text"))
    counts = docs.select("doc_id", "lang", "source", text.letter_counts(F.col("text"), ALPHABET).alias("_v"))
    return counts.select("doc_id", "lang", "source", average_hash(F.col("_v")).alias("h"))


def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a 64-bit average hash of their letter counts (whole texts), hashed once."""
    return shared(spark, d, "document_hashes", _document_hashes)


def split_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with test flag and pool rank per seed."""
    rows = embeddings(spark, d).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    rows = hash_rank(rows.withColumn("_h", seeded_order(F.col("seed"), "test", F.col("vec_id"))), ["seed", "label"], "_h", "_t", ["vec_id"], "_n")
    rows = rows.withColumn("is_test", F.col("_t") <= F.bround(F.col("_n") * 0.25)).drop("_h", "_t", "_n")
    rows = rows.withColumn("_h", seeded_order(F.col("seed"), "pool", F.col("vec_id")))
    return hash_rank(rows, ["seed", "label", "is_test"], "_h", "pool_rank", ["vec_id"]).drop("_h")


def _models(vec: str):
    return F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.slice(vec, 1, n).alias("v")) for m, n in MODELS.items()])).alias("m")


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    ranks = split_ranks(spark, d)
    target = F.col("label").isin(*TARGET_LABELS)
    k = F.explode(F.array(*[F.lit(s) for s in SHOTS])).alias("k")
    tag = F.when(F.col("pool_rank") <= F.col("k"), F.array(F.lit("uniform"), F.lit("scarce"))).when(
        ~target, F.array(F.lit("scarce"))
    ).otherwise(F.array().cast("array<string>"))
    train = ranks.filter(~F.col("is_test")).select("seed", "label", "pool_rank", "vec", k).select(
        "seed", "k", F.explode(tag).alias("tag"), "label", _models("vec")
    ).select("tag", "k", "seed", "m.model", "label", F.col("m.v").alias("v"))
    by = ["tag", "k", "seed", "model"]
    protos = prototypes(train, by, "label", "v")
    test = ranks.filter("is_test").select("seed", "vec_id", F.col("label").alias("y"), "vec", k).select(
        F.explode(F.array(F.lit("uniform"), F.lit("scarce"))).alias("tag"), "k", "seed", "vec_id", "y", _models("vec")
    ).select("tag", "k", "seed", "m.model", F.col("vec_id").alias("key"), "y", F.col("m.v").alias("v"))
    n_classes = table(spark, d, "embeddings", "label").distinct().count()
    scored = nearest_prototype(test, protos, by, "label", "v", n_classes, 2 * len(SHOTS) * len(SEEDS) * len(MODELS))
    return scored.select(*by, "key", "y", "pred", "ranked")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Prototype predictions of all runs: tag x shots x seed x model over the test items."""
    return shared(spark, d, "predictions", _predictions)


def _wrapped(ids: pa.Array, vectors: pa.Array) -> pa.Array:
    """Frames of point_clips for some vectors; coordinates beyond a vector's end are missing."""
    size = 64
    ends = vectors.offsets.to_numpy()
    starts = ends[:-1] - ends[0]
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values, at = vectors.values.slice(ends[0], ends[-1] - ends[0]), np.arange(size)
    known = at < lengths[:, None]
    spots = np.where(known, starts[:, None] + at, len(values))
    wide = np.append(pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False), 0.0)[spots]
    known &= np.append(pc.is_valid(values).to_numpy(zero_copy_only=False), False)[spots]
    turn = (pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[:, None] + np.arange(CLIP_POINT_FRAMES)) % 4 == 0
    lost = (turn | pc.is_null(ids).to_numpy(zero_copy_only=False)[:, None])[:, :, None] & _HAND
    columns = []
    for c in range(3):
        x, gone = wide[:, _SPOTS[..., c]], ~known[:, _SPOTS[..., c]] | lost
        columns.append(pa.array(x.ravel(), mask=gone.ravel()))
    points = pa.StructArray.from_arrays(columns, ["x", "y", "z"])
    frames = len(ids) * CLIP_POINT_FRAMES
    inner = pa.ListArray.from_arrays(np.arange(frames + 1, dtype=np.int32) * fixed.N_POINTS, points)
    return pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * CLIP_POINT_FRAMES, inner)


def point_clips(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as clips of 8 frames of 543 points: coordinates wrap around the vector.

    Hand points are missing in every fourth frame.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, POINT_ROWS):
                part = batch.slice(at, POINT_ROWS)
                frames = _wrapped(part.column("vec_id"), part.column("vec"))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), frames], ["vec_id", "label", "frames"])

    schema = "vec_id bigint, label int, frames array<array<struct<x:double,y:double,z:double>>>"
    return spread(embeddings(spark, d), POINT_TASK).mapInArrow(make, schema)


CTES = {
    "ev": "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "clips": """clips AS (
        SELECT CAST(event_id AS VARCHAR) AS key, event_type AS word,
          CASE k % 4 WHEN 0 THEN 'studio' WHEN 1 THEN 'camera' WHEN 2 THEN 'web' ELSE 'dictionary' END AS source,
          CASE k % 4 WHEN 0 THEN 'User' || user_id WHEN 1 THEN '' WHEN 2 THEN 'unknown' ELSE 'islrtc' END AS signer,
          CAST(floor(value) AS INTEGER) AS n_frames,
          event_type || CASE WHEN k % 4 = 1 THEN '/MVI_' ELSE '/clip_' END || event_id || '.mp4' AS video_rel,
          'licence ' || (k % 3) AS license, user_id, k, event_id
        FROM ev)""",
    "sess": f"""sess AS (
        SELECT n, max(st) OVER (ORDER BY n) AS s FROM (
          SELECT n, CASE WHEN p IS NULL OR n - p > {GAP} THEN n END AS st FROM (
            SELECT event_id AS n, lag(event_id) OVER (ORDER BY event_id) AS p FROM clips WHERE source = 'camera')))""",
    "ident": """ident AS (
        SELECT c.*, CASE WHEN signer NOT IN ('', 'unknown') THEN 'signer:' || signer
          WHEN s IS NOT NULL THEN 'session:camera_s' || s ELSE 'clip:' || source || ':' || key END AS identity
        FROM clips c LEFT JOIN sess ON c.source = 'camera' AND c.event_id = sess.n)""",
    "frames": f"""frames AS (
        SELECT *, (pos - 1) // {CLIP_FRAMES} AS clip, CAST((pos - 1) % {CLIP_FRAMES} AS INTEGER) AS frame FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM ev))""",
    "series": "series AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM ev)",
    "emb": "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)",
    "ranks": """ranks AS (
        SELECT *, row_number() OVER (PARTITION BY seed, label, is_test ORDER BY md5(seed || '|pool|' || vec_id), vec_id) AS pool_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || '|test|' || vec_id), vec_id)
            <= round_even(count(*) OVER (PARTITION BY seed, label) * 0.25, 0) AS is_test
          FROM emb CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed)))""",
    "train": """train AS (
        SELECT tag, k, seed, model, dims, label, vec[1:dims] AS v
        FROM ranks CROSS JOIN (SELECT unnest([1, 2, 4, 8]) AS k) CROSS JOIN (SELECT unnest(['uniform', 'scarce']) AS tag)
          CROSS JOIN (SELECT 'dim16' AS model, 16 AS dims UNION ALL SELECT 'dim64', 64)
        WHERE NOT is_test AND (pool_rank <= k OR (tag = 'scarce' AND label NOT IN (0, 1, 2))))""",
    "protos": """protos AS (
        SELECT tag, k, seed, model, label, list_transform(p, lambda x: x / (sqrt(list_dot_product(p, p)) + 1e-8)) AS proto FROM (
          SELECT tag, k, seed, model, label, list(m ORDER BY i) AS p FROM (
            SELECT tag, k, seed, model, label, i, avg(v[i] / nv) AS m
            FROM (SELECT *, sqrt(list_dot_product(v, v)) + 1e-8 AS nv, unnest(range(1, dims + 1)) AS i FROM train)
            GROUP BY ALL) GROUP BY ALL))""",
    "preds": """preds AS (
        SELECT tag, k, seed, model, key, y, pr[1] AS pred, pr AS ranked FROM (
          SELECT tag, k, seed, model, key, y, list(label ORDER BY s DESC, label) AS pr FROM (
            SELECT p.tag, p.k, p.seed, p.model, r.vec_id AS key, r.label AS y, p.label,
              list_dot_product(p.proto, r.vec[1:len(p.proto)])
                / (sqrt(list_dot_product(r.vec[1:len(p.proto)], r.vec[1:len(p.proto)])) + 1e-8) AS s
            FROM ranks r JOIN protos p ON r.seed = p.seed WHERE r.is_test) GROUP BY ALL))""",
}
_NEEDS = {
    "clips": ["ev"], "sess": ["clips"], "ident": ["clips", "sess"], "frames": ["ev"], "series": ["ev"], "ranks": ["emb"],
    "train": ["ranks"], "protos": ["train"], "preds": ["ranks", "protos"],
}


def with_views(*names: str, body: str, extra: str = "") -> str:
    """SQL text with the named views (and what they need) in front of the body."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in _NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [CTES[n] for n in order] + ([extra] if extra else [])
    return "WITH RECURSIVE " + ", ".join(parts) + " " + body


