"""Exact and near duplicates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.hashing import hamming64
from glossloom.operators.ranking import take_first
from glossloom.session import checkpoint


def exact_duplicates(df: DataFrame, content: Column, order: str, path: str, word: str) -> DataFrame:
    """Removed records: (kept, removed, reason, word); the first record of a content hash is kept.

    Only (hash, first, path) travels for the owner side, one row per content.
    """
    hashed = df.select(F.sha2(content, 256).alias("sha"), F.col(order).alias("_o"), F.col(path).alias("_p"), F.col(word).alias("word"))
    owner = hashed.groupBy("sha").agg(F.min(F.struct("_o", "_p")).alias("_first"))
    return (
        hashed.join(owner, "sha")
        .filter(F.col("_o") != F.col("_first._o"))
        .select(F.col("_first._p").alias("kept"), F.col("_p").alias("removed"), F.lit("sha256").alias("reason"), "word")
    )


def drop_exact(df: DataFrame, content: Column, order: str) -> DataFrame:
    """First record of every content hash."""
    return take_first(df.withColumn("sha256", F.sha2(content, 256)), ["sha256"], [order])


def clip_uid(counter_source: str, counter: Column) -> Column:
    """Cross-store identity of a clip: (word, counter) for the counter source, else (source, key)."""
    by_counter = F.concat_ws(":", F.lit(counter_source), "word", counter.cast("bigint").cast("string"))
    counted = (F.col("source") == counter_source) & counter.isNotNull()
    return F.when(counted, by_counter).otherwise(F.concat_ws(":", "source", "key"))


def keep_first_store(df: DataFrame, uid: Column, order: list[str]) -> DataFrame:
    return take_first(df.withColumn("_uid", uid), ["_uid"], order).drop("_uid")


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _pieces(cells: list[tuple[int, int]]) -> str:
    """SQL text that joins some bit ranges of h."""
    cut = (f"shiftrightunsigned(h, {lo}) & {(1 << width) - 1}L" for lo, width in cells)
    return "concat_ws('_', " + ", ".join(cut) + ")"


def near_pairs(hashes: DataFrame, group: list[str], h: str = "h", max_distance: int = 3, hot: int = 2_000) -> DataFrame:
    """Pairs of distinct hashes (h_a < h_b) of a group within max_distance bits.

    Input: distinct (group, h), materialised because it is read several times. With d differing bits at most and d + 3 blocks of
    bits, at least three blocks agree, so every pair shares one of the keys made of
    three blocks. Keys with more than `hot` hashes are split further: the bits
    outside the key are cut into d + 1 strips, one of which must agree. Both steps
    lose no pair.
    """
    d = max_distance
    blocks = _blocks(64, d + 3)
    keys, strips = [], []
    for i, chosen in enumerate(combinations(range(len(blocks)), 3)):
        keys.append(f"named_struct('t', {i}, 'k', {_pieces([blocks[j] for j in chosen])})")
        rest = [blocks[j] for j in range(len(blocks)) if j not in chosen]
        cells = [(lo + o, w) for lo, width in rest for o, w in _blocks(width, max(1, -(-(d + 1) // len(rest))))]
        parts = [f"concat('{s}:', {_pieces(cells[s :: d + 1])})" for s in range(d + 1)]
        strips.append(f"WHEN t = {i} THEN array({', '.join(parts)})")
    keyed = hashes.select(*group, F.col(h).alias("h")).select(*group, "h", F.explode(F.expr(f"array({', '.join(keys)})")).alias("_k"))
    keyed = keyed.select(*group, "h", "_k.t", "_k.k")
    sizes = keyed.groupBy(*group, "t", "k").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    sized = keyed.join(sizes, [*group, "t", "k"])
    strip = F.expr(f"CASE WHEN _n <= {hot} THEN array('') {' '.join(strips)} END")
    cells = sized.select(*group, "t", "k", F.explode(strip).alias("s"), "h")
    on = [*group, "t", "k", "s"]
    pairs = cells.withColumnRenamed("h", "h_a").join(cells.withColumnRenamed("h", "h_b"), on).filter(F.col("h_a") < F.col("h_b"))
    dist = hamming64(F.col("h_a"), F.col("h_b"))
    return pairs.filter(dist <= d).select(*group, "h_a", "h_b", dist.alias("distance")).distinct()


def greedy_near_duplicates(
    df: DataFrame, group: list[str], h: str, order: str, max_distance: int = 3, hot: int = 2_000
) -> DataFrame:
    """Every row with kept_by: the order value of the kept row it repeats, or its own.

    Rows are visited by `order`; a row is dropped when an earlier kept row of its
    group is within max_distance bits, and logged against the first such row. Equal
    hashes share one fate after their first row, so the decision runs on distinct
    hashes. A hash is decided as soon as all its earlier neighbours are, which
    gives the result of the one-by-one loop in a few distributed rounds.
    """
    nodes = checkpoint(df.groupBy(*group, F.col(h).alias("h")).agg(F.min(order).alias("_o")))
    pairs = near_pairs(nodes.select(*group, "h"), group, "h", max_distance, hot)
    a = nodes.select(*group, F.col("h").alias("h_a"), F.col("_o").alias("_oa"))
    b = nodes.select(*group, F.col("h").alias("h_b"), F.col("_o").alias("_ob"))
    edges = pairs.join(a, [*group, "h_a"]).join(b, [*group, "h_b"])
    edges = checkpoint(
        edges.select(
            F.least("_oa", "_ob").alias("early"), F.greatest("_oa", "_ob").alias("late")
        )
    )
    # Order values are unique, so they name the hashes from here on.
    state = checkpoint(
        nodes.select(F.col("_o").alias("node"))
        .join(edges.select(F.col("late").alias("node")).distinct().withColumn("_busy", F.lit(True)), "node", "left")
        .select("node", F.when(F.col("_busy").isNull(), F.lit(True)).alias("keep"), F.col("node").alias("kept_by"))
    )
    while not state.filter(F.col("keep").isNull()).isEmpty():
        look = edges.join(state.select(F.col("node").alias("early"), F.col("keep").alias("_ek")), "early")
        seen = look.groupBy(F.col("late").alias("node")).agg(
            F.min(F.when(F.col("_ek"), F.col("early"))).alias("_first"),
            F.bool_or(F.col("_ek").isNull()).alias("_open"),
            F.min(F.when(F.col("_ek").isNull(), F.col("early"))).alias("_first_open"),
        )
        # The log names the first kept neighbour, so an open earlier one must be decided first.
        dropped = F.col("_first").isNotNull() & (F.col("_first_open").isNull() | (F.col("_first") < F.col("_first_open")))
        verdict = F.when(dropped, F.lit(False)).when(F.col("_first").isNull() & ~F.col("_open"), F.lit(True))
        state = checkpoint(
            state.join(seen, "node", "left").select(
                "node",
                F.coalesce("keep", verdict).alias("keep"),
                F.when(F.col("keep").isNull() & dropped, F.col("_first")).otherwise(F.col("kept_by")).alias("kept_by"),
            )
        )
    fate = nodes.join(state.withColumnRenamed("node", "_o"), "_o").select(*group, F.col("h").alias(h), "kept_by")
    return df.join(fate, [*group, h])


def deduplicate(
    df: DataFrame, content: Column, group: list[str], h: str, order: str, path: str, max_distance: int = 3, hot: int = 2_000
) -> DataFrame:
    """Every row's path with status, kept path and reason of one pass over exact and near copies.

    Rows are visited by `order` (unique). A row whose content came before, anywhere,
    repeats the first row with it, even if that row was dropped as a near copy. Of
    the first rows, one within max_distance bits of an earlier kept row of its group
    repeats the first such row. The content hash is claimed before the near check,
    so copies never take part in it: the pass is the exact step over all rows and
    the greedy one over the first row of each content. Null group values are equal
    to each other; rows without content are no exact copies, rows without a hash no
    near ones.
    """
    sha = F.coalesce(F.sha2(content, 256), F.concat(F.lit("row:"), F.col(order).cast("string")))
    rows = df.select(
        F.col(order).alias("_o"), F.col(path).alias("_p"), F.to_json(F.struct(*group)).alias("_g"), F.col(h).alias("_h"), sha.alias("_sha")
    )
    owner = rows.groupBy("_sha").agg(F.min(F.struct("_o", "_p")).alias("_first"))
    marked = checkpoint(rows.join(owner, "_sha"))
    is_first = F.col("_o") == F.col("_first._o")
    exact = marked.filter(~is_first).select(
        F.col("_p").alias(path), F.lit("exact_sha_duplicate").alias("status"), F.col("_first._p").alias("kept"), F.lit("sha256").alias("reason")
    )
    first = marked.filter(is_first).select("_o", "_p", "_g", "_h")
    seen = greedy_near_duplicates(first.filter("_h IS NOT NULL"), ["_g"], "_h", "_o", max_distance, hot)
    named = seen.join(first.select(F.col("_o").alias("kept_by"), F.col("_p").alias("_k")), "kept_by")
    near = F.col("kept_by") != F.col("_o")
    decided = named.select(
        F.col("_p").alias(path), F.when(near, "near_phash_duplicate").otherwise("kept").alias("status"),
        F.when(near, F.col("_k")).alias("kept"), F.when(near, f"phash<={max_distance} same signer").alias("reason"),
    )
    alone = first.filter("_h IS NULL").select(
        F.col("_p").alias(path), F.lit("kept").alias("status"), F.lit(None).cast(df.schema[path].dataType).alias("kept"), F.lit(None).cast("string").alias("reason")
    )
    return exact.unionByName(decided).unionByName(alone)
