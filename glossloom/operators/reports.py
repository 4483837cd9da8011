"""Coverage, statistics and inspection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions.hashing import key_fingerprint, seeded_order
from glossloom.functions.points import FACE, LEFT, RIGHT
from glossloom.operators.ranking import cap_per_group


def word_coverage(targets: DataFrame, clips: DataFrame, full: int = 40) -> DataFrame:
    """Videos, signers, sources and status per target word; words without clips are kept."""
    per = clips.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("signer").alias("signers"),
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"),
    )
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    status = F.when(n >= full, "ok").when(n > 0, "partial").otherwise("missing")
    return targets.join(per, "word", "left").select(
        "word", n.alias("videos_found"), F.coalesce("signers", F.lit(0).cast("bigint")).alias("unique_signers"),
        F.coalesce("sources", F.lit("none")).alias("sources"), (n >= full).alias("target_met"), status.alias("status"),
    )


def global_statistics(records: DataFrame, n_targets: int, **extra: int) -> DataFrame:
    """(metric, value) rows from one aggregate."""
    one = records.agg(
        F.count(F.lit(1)).alias("accepted_videos"), F.count_distinct("signer").alias("unique_signers"),
        F.count_distinct("dataset").alias("source_datasets"),
    ).withColumn("target_words", F.lit(n_targets).cast("bigint"))
    for name, value in extra.items():
        one = one.withColumn(name, F.lit(value).cast("bigint"))
    return one.unpivot([], one.columns, "metric", "value")


def source_table(clips: DataFrame) -> DataFrame:
    """Per source and for ALL: clips, words, identities, clips with signer, median frames, licences."""
    has_signer = F.length(F.coalesce("signer", F.lit(""))) > 0
    grouped = clips.rollup("source").agg(
        F.grouping("source").alias("_all"), F.count(F.lit(1)).alias("clips"), F.count_distinct("word").alias("words"),
        F.count_distinct("identity").alias("identities"), F.count_if(has_signer).alias("_signer_ids"),
        F.percentile("n_frames", 0.5).alias("median_frames"),
        F.concat_ws("; ", F.slice(F.array_sort(F.collect_set("license")), 1, 2)).alias("_licence"),
    )
    whole = F.col("_all") == 1
    return grouped.select(
        F.when(whole, "ALL").otherwise(F.col("source")).alias("source"), "clips", "words", "identities",
        F.when(whole, F.lit(None)).otherwise(F.col("_signer_ids")).alias("signer_ids"), "median_frames",
        F.when(whole, "").otherwise(F.col("_licence")).alias("licence"),
    )


def clips_per_word(clips: DataFrame, enough: int = 3) -> DataFrame:
    per = clips.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.min("n").alias("min_clips"), F.percentile("n", 0.5).alias("median_clips"), F.max("n").alias("max_clips"),
        F.count_if(F.col("n") >= enough).alias("words_enough"), F.count(F.lit(1)).alias("n_words"),
    )


def detection_rates(clips: DataFrame, per_source: int = 40, seed: int = 0, frames: str = "frames") -> DataFrame:
    """Share of frames with any point of each part, averaged over a seeded sample of clips per source.

    `frames` is array<array<struct<x,y,z>>>; a missing point has a null or NaN x.
    """
    hashed = clips.select("source", "key").withColumn("_h", seeded_order(seed, F.col("key")))
    picked = cap_per_group(hashed, ["source"], "_h", per_source, ["key"]).select("source", "key")
    sample = clips.join(picked, ["source", "key"], "left_semi")
    seen = lambda p: p["x"].isNotNull() & ~F.isnan(p["x"])
    spans = {"pose": (1, LEFT), "left_hand": (LEFT + 1, RIGHT - LEFT), "right_hand": (RIGHT + 1, FACE - RIGHT), "face": (FACE + 1, fixed.N_FACE)}

    def share(at: int, n: int):
        hits = F.transform(F.col(frames), lambda f: F.exists(F.slice(f, at, n), seen).cast("int"))
        return F.aggregate(hits, F.lit(0), lambda s, v: s + v) / F.size(frames)

    return sample.groupBy("source").agg(
        F.count(F.lit(1)).alias("clips_sampled"), *[(100 * F.avg(share(*s))).alias(f"{k}_pct") for k, s in spans.items()]
    )


def test_counts(words: DataFrame, test: DataFrame) -> DataFrame:
    """Test clips per word of the vocabulary, zeros included."""
    per = test.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.join(per, "word", "left").select("word", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_test"))


def split_words(split: DataFrame) -> DataFrame:
    return split.groupBy("word").agg(
        F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "test").alias("n_test")
    )


def split_info(split: DataFrame, targets: list[str], shots: int | None, scarce: bool = True) -> DataFrame:
    """One row: sizes, missing targets, words without test clips or short of shots, maps, fingerprints."""
    targets = sorted(targets)
    per = split_words(split)
    is_target = F.col("word").isin(targets)
    due = is_target if scarce else F.lit(True)
    short = due & (F.col("n_train") < F.lit(shots)) if shots else F.lit(False)
    to_map = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", v))))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("word"))))
    info = per.agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"),
        F.sum(F.when(is_target, F.col("n_test")).otherwise(0)).alias("n_test_target"), names(is_target).alias("targets"),
        names(F.col("n_test") == 0).alias("words_without_test"), names(short).alias("shots_short"),
        to_map("n_train").alias("train_per_word"), to_map("n_test").alias("test_per_word"),
    ).withColumn("missing_targets", F.array_except(F.array(*[F.lit(t) for t in targets]), "targets"))
    prints = key_fingerprint(split, ["side"], "key")
    ids = split.groupBy("side").agg(F.count_distinct("identity").alias("n_ids"))
    at = F.struct("fingerprint", "n_ids")
    sides = prints.join(ids, "side").agg(F.map_from_entries(F.collect_list(F.struct("side", at)))).scalar()
    out = info.withColumn("_s", sides)
    for side in ("train", "test"):
        found = F.try_element_at("_s", F.lit(side))
        out = out.withColumn(f"{side}_fingerprint", found["fingerprint"]).withColumn(f"n_{side}_identities", found["n_ids"])
    return out.drop("_s")


def feasibility(pool_ranks: DataFrame, test: DataFrame, shots: list[int], targets: list[str]) -> DataFrame:
    """Per seed and K of the scarce protocol: sizes of the split the ranked pools would give.

    pool_ranks: (seed, word, n_pool), the pool size per word; test: (seed, word, n_test).
    Target words keep min(n_pool, K) clips, other words all.
    """
    is_target = F.col("word").isin(targets)
    rows = pool_ranks.join(test, ["seed", "word"], "left").withColumn("k", F.explode(F.array(*[F.lit(s) for s in shots])))
    train = F.when(is_target, F.least("n_pool", "k")).otherwise(F.col("n_pool"))
    n_test = F.coalesce("n_test", F.lit(0).cast("bigint"))
    return rows.groupBy("seed", "k").agg(
        F.count(F.lit(1)).alias("words"), F.count_if(is_target).alias("targets"), F.sum(train).alias("train"),
        F.sum(n_test).alias("test"), F.sum(F.when(is_target, n_test).otherwise(0)).alias("test_targets"),
        F.count_if(n_test == 0).alias("words_without_test"), F.count_if(is_target & (F.col("n_pool") < F.col("k"))).alias("targets_short"),
    )


def normalization_map(records: DataFrame, order: str) -> DataFrame:
    """First review status of every (original label, normalised word, source)."""
    keys = ["original_label", "normalized_word", "dataset"]
    return records.groupBy(*keys).agg(F.min_by("review_status", order).alias("review_status"))


def word_sources(records: DataFrame) -> DataFrame:
    return records.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("dataset")), "\n").alias("sources"))


def inventory(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per listed source, found or not: its listed columns, then clips, words and signers that came from it."""
    found = clips.groupBy("source").agg(
        F.count(F.lit(1)).alias("clips"), F.count_distinct("word").alias("words"), F.count_distinct(F.nullif(F.trim("signer"), F.lit(""))).alias("signers")
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("clips", "words", "signers")]
    return sources.join(found, "source", "left").select(*sources.columns, *counts, (F.coalesce("clips", F.lit(0)) > 0).alias("found"))


def licences(clips: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Clips per source and licence; a blank licence is reported as unknown and needs a review."""
    name = F.coalesce(F.nullif(F.trim("license"), F.lit("")), F.lit(unknown))
    rows = clips.groupBy("source", name.alias("licence")).agg(F.count(F.lit(1)).alias("clips"))
    return rows.withColumn("needs_review", F.col("licence") == unknown)
