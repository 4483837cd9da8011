"""Landmark frames in long format, and their competition index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions import points, text
from glossloom.functions.bind import let
from glossloom.functions.hashing import seeded_order
from glossloom.functions.sequence import resample, trim_ends
from glossloom.operators.joins import small_side

# Part names and sizes in file order.
FILE_PARTS = (("face", fixed.N_FACE), ("left_hand", fixed.N_HAND), ("pose", fixed.N_POSE), ("right_hand", fixed.N_HAND))


def _offset(kind: Column) -> Column:
    out, at = None, 0
    for name, size in FILE_PARTS:
        out = F.when(kind == name, F.lit(at)) if out is None else out.when(kind == name, F.lit(at))
        at += size
    return out


def dense_frames(long: DataFrame, by: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(good, bad): frames as arrays in storage order, and the frames of a wrong shape.

    long: (by, frame, type, landmark_index, x, y, z). A frame is good when every one
    of the points appears exactly once under a known part.
    """
    slot = (_offset(F.col("type")) + F.col("landmark_index")).alias("slot")
    rows = long.select(by, "frame", slot, "x", "y", "z")
    counts = rows.groupBy(by, "frame").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("lo"), F.max("slot").alias("hi")
    )
    fine = (F.col("n") == fixed.N_POINTS) & (F.col("slots") == fixed.N_POINTS) & (F.col("lo") == 0) & (F.col("hi") == fixed.N_POINTS - 1)
    # Only frames of the right size are gathered, so a broken frame with many rows stays a count.
    whole = rows.join(counts.filter(fine).select(by, "frame"), [by, "frame"], "left_semi")
    packed = whole.groupBy(by, "frame").agg(F.array_sort(F.collect_list(F.struct("slot", "x", "y", "z"))).alias("_p"))
    ordered = F.transform("_p", lambda p: points.xyz(p["x"], p["y"], p["z"]))
    good = packed.select(by, "frame", points.from_face_first(ordered).alias("points"))
    return good, counts.filter(~fine | fine.isNull()).select(by, "frame", "n", "slots")


def read_long(spark: SparkSession, root: str) -> DataFrame:
    """All sequence files below root with their relative path; only the used columns are read."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    seq = F.substring_index(F.col("_metadata.file_path"), root.rstrip("/") + "/", -1)
    return rows.select(seq.alias("seq"), "frame", "type", "landmark_index", "x", "y", "z")


def competition_index(meta: DataFrame, frames: DataFrame, signs: DataFrame | None = None, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Clip rows of the wanted sequences. meta: (path, participant_id, sequence_id, sign); frames: (seq, frame, ...)."""
    if signs is not None:
        meta = meta.join(small_side(signs.select("sign").distinct()), "sign", "left_semi")
    if sample:
        meta = meta.orderBy(seeded_order(seed, F.col("path")), "path").limit(sample)
    counts = frames.groupBy(F.col("seq").alias("path")).agg(F.count(F.lit(1)).alias("n_frames"))
    rel = F.concat_ws("/", F.col("participant_id").cast("string"), F.col("sequence_id").cast("string"))
    key = text.clip_key(F.lit(fixed.COMPETITION_SOURCE), rel)
    return meta.join(counts, "path").select(
        key.alias("key"), F.col("sign").alias("word"), F.lit(fixed.COMPETITION_SOURCE).alias("source"),
        F.concat(F.lit("asl"), F.col("participant_id").cast("string")).alias("signer"), "n_frames", F.lit("30").alias("fps"),
        F.concat(F.lit("npy/"), key, F.lit(".npy")).alias("path"), F.col("path").alias("video_rel"),
    )


def model_input(frames: Column, hands_seen: Column | None = None, n: int = fixed.MODEL_FRAMES) -> Column:
    """Clip of frames to the fixed-length, normalised, reduced and flattened form."""
    if hands_seen is None:
        seen = lambda f: F.exists(F.slice(f, points.LEFT + 1, 2 * fixed.N_HAND), lambda p: p["x"].isNotNull() & ~F.isnan(p["x"]))
        hands_seen = F.transform(frames, seen)
    # The anchors of the normalisation are among the kept points, so the points are cut first.
    ready = lambda f: points.flat(points.normalize_position(points.zero_missing(points.reduced(f))))
    # Of a short clip, whose last frame is repeated, every frame is made ready once.
    short = lambda kept: F.size(kept) < n
    made = lambda kept: resample(F.transform(F.when(short(kept), kept).otherwise(resample(kept, n)), ready), n)
    return let(trim_ends(frames, hands_seen), made)
