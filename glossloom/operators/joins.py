"""Label matching, alignment and paired joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions import text

# A side is broadcast only up to this many rows; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint after a bounded count; beyond the limit the plain join runs."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def match_targets(df: DataFrame, label: Column, targets: DataFrame) -> DataFrame:
    """Adds (target, match): equal label first, then equal without spaces.

    `targets` has the columns (word, pos); of several space-free hits the first wins.
    """
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    rows = df.withColumn("_n", label).withColumn("_c", squeeze(F.col("_n")))
    exact = targets.groupBy(F.col("word").alias("_n")).agg(F.min("pos").alias("_p1"))
    loose = targets.groupBy(squeeze(F.col("word")).alias("_c")).agg(F.min_by("word", "pos").alias("_w2"))
    joined = rows.join(small_side(exact), "_n", "left").join(small_side(loose), "_c", "left")
    hit = F.col("_p1").isNotNull()
    return joined.withColumn("target", F.when(hit, F.col("_n")).otherwise(F.col("_w2"))).withColumn(
        "match", F.when(hit, "exact").when(F.col("_w2").isNotNull(), "normalized").otherwise("no_match")
    ).drop("_n", "_c", "_p1", "_w2")


def review_status(match: Column, label: Column) -> Column:
    """accepted / normalized_match, or a manual review for bridged labels."""
    bridged = label.isin(*fixed.REVIEW_ALIASES)
    return (
        F.when(match == "exact", "accepted").when(match == "normalized", "normalized_match")
        .when(bridged, "Needs Manual Review")
    )


def align_words(requested: DataFrame, labels: DataFrame, word: str = "word", norm: str | None = None) -> DataFrame:
    """Requested names (name, pos) with the label they stand for, null when missing.

    A label is known by its token, its lower-case form and that form with
    underscores; a later label overwrites an earlier one, in sorted order. Tokens of
    normalised forms come after all of them. Every label is listed once, at its
    first request.
    """
    cols = [word] + ([norm] if norm else [])
    distinct = labels.select(*cols).distinct()
    low = F.lower(word)
    forms = [
        F.struct(text.token(F.col(word)).alias("a"), F.lit(0).alias("o")),
        F.struct(low.alias("a"), F.lit(1).alias("o")),
        F.struct(F.replace(low, F.lit(" "), F.lit("_")).alias("a"), F.lit(2).alias("o")),
    ]
    if norm:
        forms.append(F.struct(text.token(F.col(norm)).alias("a"), F.lit(3).alias("o")))
    alias = distinct.select(F.col(word).alias("_w"), F.explode(F.array(*forms)).alias("f"))
    alias = alias.groupBy(F.col("f.a").alias("_a")).agg(F.max_by("_w", F.struct(F.col("f.o") == 3, F.col("_w"), F.col("f.o"))).alias("_w"))
    by_token = requested.withColumn("_a", text.token(F.col("name"))).join(alias, "_a", "left")
    by_token = by_token.select("name", "pos", F.col("_w").alias("_w1"), F.lower(F.trim("name")).alias("_a"))
    both = by_token.join(alias, "_a", "left").select("name", "pos", F.coalesce("_w1", "_w").alias("word"))
    first = both.filter(F.col("word").isNotNull()).groupBy("word").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))
    lost = both.filter(F.col("word").isNull()).select("word", "name", "pos")
    return first.unionByName(lost).withColumn("found", F.col("word").isNotNull())


def top_words(clips: DataFrame, k: int = 8) -> DataFrame:
    counts = clips.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(k)


def resolve_words(clips: DataFrame, raw: list[str] | None, n_words: int = 8) -> DataFrame:
    """Chosen words by mode: none or top -> most clips, all, legacy8, topK, or a list."""
    first = raw[0].strip().lower() if raw and len(raw) == 1 else None
    if not raw or first == "top":
        return top_words(clips, n_words).select("word")
    if first in ("all", "*"):
        return clips.select("word").distinct()
    if first and first.startswith("top") and first[3:].isdigit():
        return top_words(clips, int(first[3:])).select("word")
    names = list(fixed.TARGET_WORDS) if first in ("legacy8", "eight", "old8") else raw
    asked = clips.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "name string, pos int")
    return align_words(asked, clips).filter("found").select("word")


def unfinished(jobs: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Work that has no finished row."""
    return jobs.join(done.select(*on).distinct(), on, "left_anti")


def stem_match(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Best file per wanted uid: stem equal to the uid, then to its first part, then by prefix.

    wanted: (uid). files: (path). The prefix step runs on the part before the first
    underscore of both sides as an equi-join key, so no loop join is planned; a stem
    starts with the uid's first part only if its own first part does, and shorter
    first parts are matched through every prefix of the stem.
    """
    stems = files.select("path", text.file_stem(F.col("path")).alias("stem"))
    part = F.element_at(F.split("uid", "_"), 1)
    names = wanted.select("uid", F.explode(F.array_distinct(F.array(F.col("uid"), part))).alias("stem")).withColumn(
        "rank", F.when(F.col("stem") == F.col("uid"), 0).otherwise(1)
    )
    exact = names.join(stems, "stem").select("uid", "rank", "path")
    left = wanted.join(exact.select("uid").distinct(), "uid", "left_anti").withColumn("_p", part)
    lengths = left.select(F.length("_p").alias("n")).agg(F.min("n"), F.max("n")).first()
    best = exact
    if lengths[0] is not None:
        sizes = F.sequence(F.lit(lengths[0]), F.lit(lengths[1]))
        prefixes = stems.select("path", "stem", F.explode(F.filter(sizes, lambda n: n <= F.length("stem"))).alias("_n"))
        prefixes = prefixes.select("path", F.col("stem").substr(F.lit(1), F.col("_n")).alias("_p"))
        near = left.join(prefixes, "_p").select("uid", F.lit(2).alias("rank"), "path")
        best = exact.unionByName(near)
    return best.groupBy("uid").agg(F.min(F.struct("rank", "path")).alias("b")).select("uid", "b.path", "b.rank")


def locked_rows(df: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of a locked path list (path, pos) in list order; either path column may match."""
    keys = df.withColumn("path", F.explode(F.array_distinct(F.array("video_path", "abs_path"))))
    return paths.join(keys, "path", "left").withColumn("found", F.col("video_path").isNotNull())


def paired_runs(preds: DataFrame, reference: str) -> DataFrame:
    """Each run next to the reference run of the same (tag, k, seed), item by item."""
    ok = F.col("y") == F.col("pred")
    on = ["tag", "k", "seed", "key"]
    ref = preds.filter(F.col("model") == reference).select(*on, ok.alias("a_ok"))
    return preds.filter(F.col("model") != reference).select(*on, "model", "y", ok.alias("b_ok")).join(ref, on)


def cross_tag_pairs(preds: DataFrame, tag_a: str, tag_b: str) -> DataFrame:
    """Same model, k, seed and item under two tags."""
    ok = F.col("y") == F.col("pred")
    on = ["model", "k", "seed", "key"]
    a = preds.filter(F.col("tag") == tag_a).select(*on, "y", ok.alias("a_ok"))
    return a.join(preds.filter(F.col("tag") == tag_b).select(*on, ok.alias("b_ok")), on)


def model_pairs(preds: DataFrame, on: list[str]) -> DataFrame:
    """Discordant counts of all model pairs (a < b) that cover the same items.

    The correctness of every model is folded into one array per item first; the
    pairs are formed inside that array, whose size is the number of models.
    """
    sizes = preds.groupBy("model").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("full"))
    per_item = preds.groupBy(*on).agg(
        F.array_sort(F.collect_list(F.struct("model", (F.col("y") == F.col("pred")).alias("ok")))).alias("m")
    )
    pairs = F.expr(
        "flatten(transform(m, (a, i) -> transform(slice(m, i + 2, size(m)), b -> "
        "struct(a.model AS model_a, b.model AS model_b, a.ok AS a_ok, b.ok AS b_ok))))"
    )
    rows = per_item.select(F.explode(pairs).alias("p")).select("p.*")
    counted = rows.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("a_ok") & ~F.col("b_ok")).alias("a_better"),
        F.count_if(~F.col("a_ok") & F.col("b_ok")).alias("b_better"),
    )
    return counted.join(sizes, F.col("n") == F.col("full")).drop("full")


def archive_status(listing: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Expected size against size on disk: OK, else HAVE n (-1 when absent)."""
    have = F.coalesce("disk_size", F.lit(-1).cast("bigint"))
    joined = listing.join(on_disk.select("key", F.col("size").alias("disk_size")), "key", "left")
    return joined.select(
        "key", F.col("size").alias("expected"),
        F.when(have == F.col("size"), F.lit("OK")).otherwise(F.concat(F.lit("HAVE "), have.cast("string"))).alias("status"),
    )


def priority_rank(key: Column, prefixes: list[str]) -> Column:
    """Index of the first matching prefix, null without one."""
    out = F.when(key.startswith(prefixes[0]), F.lit(0))
    for i, p in enumerate(prefixes[1:], 1):
        out = out.when(key.startswith(p), F.lit(i))
    return out


def expand_grid(spark, axes: dict[str, list], variants: list[dict], base: dict) -> DataFrame:
    """One row per variant and combination of axis values, later settings over earlier ones.

    Rows come from exploding literal arrays; the first row of a run name is kept by
    the caller through take_first on `pos`.
    """
    names = list(dict.fromkeys([*base, *[k for v in variants for k in v], *axes]))
    row = spark.range(1).withColumn("_v", F.explode(F.array(*[F.lit(i) for i in range(len(variants))])))
    pos = F.col("_v").cast("bigint")
    for axis, values in axes.items():
        row = row.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_i_{axis}", f"_a_{axis}"))
        pos = pos * len(values) + F.col(f"_i_{axis}")
    cols = [pos.alias("pos")]
    for n in names:
        col = F.lit(base.get(n))
        for i, v in enumerate(variants):
            if n in v:
                col = F.when(F.col("_v") == i, F.lit(v[n])).otherwise(col)
        cols.append((F.col(f"_a_{n}") if n in axes else col).alias(n))
    return row.select(*cols)
