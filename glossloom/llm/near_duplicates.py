"""Near duplicates by chosen-path set similarity join on shingle sets.

Texts with equal sets are one vertex. Every vertex has a sketch of minwise
tokens. In each of several independent trees a node picks a few positions of the
sketch, about 1 / similarity of them, and its vertices go to a child for each
picked position and token there; nodes that are small enough are compared
exhaustively, larger ones branch again. Links are confirmed on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import discard, if_small, ship, stored, text_or_empty
from glossloom.llm.components import components
from glossloom.llm.shingles import Sets, WordHashes, groups, mix, shingle_set, sketch

SHINGLE, SIMILARITY = 5, 85
#: Positions of a sketch and the recall wanted of one pair at the threshold that has to pass LEVELS branchings.
POSITIONS, RECALL, LEVELS = 64, 0.99999, 3
#: A node of at most so many vertices is compared; a larger one branches, at most so often.
SMALL, DEEPEST = 256, 4
#: Trees whose links are confirmed before the others are looked at, and so name most groups.
FIRST = 2
#: Ids (one narrow column) up to which texts are looked up without a shuffle of the texts.
FEW_IDS = 500_000
#: Branchings and fresh seeds for what a large node holds apart from its most frequent label.
FURTHER, SEEDS = 10, 4
#: Times SMALL up to which a node of sets that are mostly alike is compared whole, as branching would not part them.
WHOLE = 8
#: Sets, and elements of all sets, from and up to which a group's common elements are counted as a matrix product.
MATRIX_SETS, MATRIX_ELEMENTS, MATRIX_COLUMNS = 8, 4_000_000, 1024
#: Rows that a comparing task gathers before it hands them on.
ROWS_OUT = 10_000
#: Standard deviations by which a sketch may underrate a pair that is still compared.
SLACK = 4.5

_SEEDS = mix(np.arange(1, 1 + 1024, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sets(batch: pd.DataFrame, words: WordHashes, k: int) -> list[np.ndarray]:
    return [shingle_set(words.of(t), k) for t in batch["t"]]


def vertex_of(s: np.ndarray) -> int:
    """A signed 64-bit number for a set: equal sets, equal numbers."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def sketched(docs: DataFrame, text: str, doc_id: str, k: int, positions: int) -> DataFrame:
    """doc_id, n_shingles, vertex, sketch and bits of every row; the last three are null for an empty set.

    bits holds the low byte of every position of the sketch: equal positions stay
    equal, and other ones agree by chance in one of 256, which only adds to what is
    compared.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.iloc[at : at + 128]
                sets = _sets(part, words, k)
                some = [i for i, s in enumerate(sets) if len(s)]
                rows = dict(zip(some, sketch([sets[i] for i in some], _SEEDS[:positions]))) if some else {}
                binary = lambda kind: [rows[i].astype(kind).tobytes() if i in rows else None for i in range(len(sets))]
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "n_shingles": [len(s) for s in sets], "vertex": pd.array([vertex_of(s) if len(s) else None for s in sets], dtype="Int64"),
                    "sketch": binary(np.uint32), "bits": binary(np.uint8),
                })

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), text_or_empty(text).alias("t")).mapInPandas(build, "id string, n_shingles long, vertex long, sketch binary, bits binary")
    return rows.select(F.col("id").cast(kind).alias("doc_id"), "n_shingles", "vertex", "sketch", "bits")


def trees_for(recall: float, similarity: int, levels: int) -> int:
    """Trees that find a pair at the threshold with the wanted probability, if each has to pass so many branchings."""
    one = (similarity / 100) ** levels
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def _picked(node: int, positions: int, similarity: int) -> np.ndarray:
    """Positions that a node picks: 1 / similarity of them in the mean, at least one."""
    rng = np.random.default_rng(node & (2**64 - 1))
    more = rng.random() < 100 / similarity - 1
    return rng.choice(positions, 2 if more else 1, replace=False)


def _branch(frame: DataFrame, positions: int, similarity: int) -> DataFrame:
    """Children (node, vertex, c) of the rows (node, vertex, c, sketch)."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, tokens = batch["node"].to_numpy(), np.stack([np.frombuffer(s, np.uint32) for s in batch["sketch"]]) if len(batch) else np.zeros((0, positions), np.uint32)
            out = []
            for node in np.unique(nodes):
                rows = np.flatnonzero(nodes == node)
                for p in _picked(int(node), positions, similarity):
                    child = mix(mix(np.full(len(rows), node).astype(np.uint64) + np.uint64(p + 1)) ^ tokens[rows, p].astype(np.uint64))
                    out.append(pd.DataFrame({"node": child.astype(np.int64), "vertex": batch["vertex"].to_numpy()[rows], "c": batch["c"].to_numpy()[rows]}))
            yield pd.concat(out) if out else pd.DataFrame({x: pd.Series(dtype="int64") for x in ("node", "vertex", "c")})

    return frame.select("node", "vertex", "c", "sketch").mapInPandas(grow, "node long, vertex long, c long")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (node, vertex, c) of nodes with at least two labels, with the node's size n and how many of it are joined to others (k)."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") != F.col("vertex")).alias("k"), F.min("c").alias("low"), F.max("c").alias("high"))
    return rows.join(sizes.filter("low < high").select("node", "n", "k"), "node")


def _agreeing(tokens: np.ndarray) -> np.ndarray:
    """Number of positions where two sketches agree, for all pairs of a node (one matrix of its size)."""
    if len(tokens) <= 16:
        return (tokens[:, None] == tokens).sum(axis=2)
    counts = np.zeros((len(tokens), len(tokens)), np.uint8 if tokens.shape[1] < 256 else np.uint16)
    for column in np.ascontiguousarray(tokens.T):
        counts += column[:, None] == column
    return counts


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's connected component in a symmetric matrix of links."""
    roots = np.full(len(linked), -1)
    for i in range(len(linked)):
        if roots[i] < 0:
            reached = np.zeros(len(linked), bool)
            reached[i] = True
            edge = np.array([i])
            while len(edge):
                more = linked[edge].any(axis=0) & ~reached
                reached |= more
                edge = np.flatnonzero(more)
            roots[reached] = i
    return roots


def _alike(rows: DataFrame, similarity: int) -> DataFrame:
    """(member, vertex, c): within each node (node, vertex, bits, n_shingles, c), groups of vertices whose sketches allow a link.

    The name of a group is a hash of its members, so a group found in several
    nodes and trees is one group. With c, the label of what is already joined, only
    vertices that resemble one of another label are in a group.
    """
    level = similarity / 100

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for g in groups(batches, "node"):
            c = g["c"].to_numpy()
            if (c == c[0]).all():
                continue
            v, n = g["vertex"].to_numpy(), g["n_shingles"].to_numpy()
            tokens = np.frombuffer(b"".join(g["bits"]), np.uint8).reshape(len(v), -1)
            near = level - SLACK * math.sqrt(level * (1 - level) / tokens.shape[1])
            linked = _agreeing(tokens) >= near * tokens.shape[1]
            linked &= np.minimum(n[:, None], n) * 100 >= similarity * np.maximum(n[:, None], n)
            linked &= c[:, None] != c
            roots = _roots(linked)
            names, sizes = np.unique(roots, return_counts=True)
            for r in names[sizes > 1]:
                at = np.flatnonzero(roots == r)
                members, first = np.unique(v[at], return_index=True)
                if len(members) > 1:
                    out.append((np.full(len(members), vertex_of(members)), members, c[at][first]))
                    held += len(members)
            if held >= ROWS_OUT:
                yield frame(out)
                out, held = [], 0
        if out:
            yield frame(out)

    def frame(out: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(["member", "vertex", "c"], [np.concatenate(x) for x in zip(*out)])))

    return rows.select("node", "vertex", "bits", "n_shingles", "c").repartition("node").sortWithinPartitions("node").mapInPandas(part, "member long, vertex long, c long").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of all pairs of sets: a product of the matrix of sets and elements that several hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = held[element] > 1
    owner, element = owner[several], (np.cumsum(held > 1) - 1)[element[several]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(element[-1]) + 1 if len(element) else 0, MATRIX_COLUMNS):
        a, b = np.searchsorted(element, (first, first + MATRIX_COLUMNS))
        holds = np.zeros((len(sets), MATRIX_COLUMNS), np.float32)
        holds[owner[a:b], element[a:b] - first] = 1
        counts += holds @ holds.T
    return counts.astype(np.int64)


def _confirmed(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that join what is linked within each group, links being confirmed on whole sets.

    Pairs already joined are not looked at, here or, by their labels (c), before.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "member"):
            v, c, s = g["vertex"].to_numpy(), g["c"].to_numpy(), [np.frombuffer(x, np.uint64) for x in g["set"]]
            n, joined, a, b = np.array([len(x) for x in s]), Sets(len(v)), [], []
            first: dict[int, int] = {}
            for i, x in enumerate(c):
                joined.join(first.setdefault(x, i), i)
            if len(v) >= MATRIX_SETS and n.sum() <= MATRIX_ELEMENTS:
                both = _common(s)
                linked = 100 * both >= similarity * (n[:, None] + n - both)
                roots = _roots(linked | (c[:, None] == c))
                for i in first.values():
                    if joined.join(roots[i], i):
                        a.append(v[i])
                        b.append(v[roots[i]])
            else:
                for i in range(len(v) - 1):
                    for j in i + 1 + np.flatnonzero(np.minimum(n[i], n[i + 1 :]) * 100 >= similarity * np.maximum(n[i], n[i + 1 :])):
                        if joined.root(i) != joined.root(int(j)):
                            both = len(np.intersect1d(s[i], s[j], assume_unique=True))
                            if 100 * both >= similarity * (len(s[i]) + len(s[j]) - both):
                                joined.join(i, int(j))
                                a.append(v[i])
                                b.append(v[j])
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return members.join(sets, "vertex").repartition("member").sortWithinPartitions("member").mapInPandas(compare, "a long, b long")


def _name(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: int = SIMILARITY, positions: int = POSITIONS,
    recall: float = RECALL, small: int = SMALL, deepest: int = DEEPEST,
) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (doc_id = component_id) of every row.

    Null, empty and blank texts have an empty set and stay alone, as do texts that
    resemble no other. Rows that repeat are linked; rows with one id but different
    texts are separate texts. A null id is never a component's id if the component
    has another, and such a row is not kept. Other columns are ignored. An empty
    table gives no rows.

    A vertex is named by a 64-bit hash of its set. Links of the first trees are
    confirmed before the others are looked at, whose groups then hold only vertices
    that resemble one of another label, so a set is sent once or twice; nodes of one
    label go no further. Nodes that stay large after the deepest branching mostly
    hold sets that are alike: they are cut into chunks around a leader, and what is
    not joined to the rest is compared with all of the node if that is no more than
    WHOLE times small, else it branches further until few of it is left in a node,
    then meets every chunk.
    """
    ship(docs.sparkSession)
    rows = stored(sketched(docs, text, doc_id, shingle, positions), "sketches")
    vertices = stored(rows.filter("vertex IS NOT NULL").groupBy("vertex").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits")), "vertices")

    def sets_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 128):
                found = [s for s in _sets(batch.iloc[at : at + 128], words, shingle) if len(s)]
                yield pd.DataFrame({"vertex": np.array([vertex_of(s) for s in found], np.int64), "set": [s.tobytes() for s in found]})

    texts = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("t")).withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))

    def sets_of(members: DataFrame) -> DataFrame:
        wanted = members.select("vertex").distinct().join(vertices.select("vertex", "id"), "vertex")
        ids = stored(wanted.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id")).distinct(), "wanted")
        return stored(texts.join(if_small(ids, FEW_IDS), "id", "left_semi").select("t").mapInPandas(sets_again, "vertex long, set binary"), "sets")

    def labels(links: DataFrame) -> DataFrame:
        """All vertices with the label of what the links join (c)."""
        label = if_small(stored(components(links), "components")).withColumnRenamed("v", "vertex")
        return stored(vertices.drop("id").join(label, "vertex", "left").withColumn("c", F.coalesce("c", "vertex")), "known")

    def joined(candidates: DataFrame, known: DataFrame) -> DataFrame:
        """The links that the candidate groups (node, vertex) add to what is known."""
        members = stored(_alike(candidates.join(known.select("vertex", "bits", "n_shingles", "c"), "vertex"), similarity), "members")
        sets = sets_of(members)
        more = stored(_confirmed(members, sets, similarity), "links")
        discard(members)
        discard(sets)
        return more

    names = [int(mix(np.array([t + 1], np.uint64)).astype(np.int64)[0]) for t in range(trees_for(recall, similarity, LEVELS))]
    links = rest = None
    for roots in (names[:FIRST], names[FIRST:]):
        if roots:
            known = labels(links) if links else vertices.withColumn("c", F.col("vertex"))
            done, large = _tree(known, roots, positions, similarity, small, deepest)
            nodes = _around_leaders(large, small)
            for part in done:
                nodes = nodes.unionByName(part)
            more, left = joined(nodes, known), large.select("node", "vertex")
            if links:
                discard(known)
            links, rest = (links.unionByName(more), rest.unionByName(left)) if links else (more, left)
    if rest.limit(1).count():
        known = labels(links)
        links = links.unionByName(joined(_apart(rest, known, positions, similarity, small), known))
        discard(known)
    return _labelled(rows, stored(components(links), "components"))


def _tree(known: DataFrame, roots: list[int], positions: int, similarity: int, small: int, deepest: int) -> tuple[list[DataFrame], DataFrame]:
    """(nodes to compare as rows (node, vertex), rows of nodes still large after the deepest branching).

    Nodes are compared when they are small, or when up to WHOLE times as large and
    at least a quarter of their vertices is joined already, so that they hardly part.
    """
    frontier = _branch(known.select(F.explode(F.array(*[F.lit(r) for r in roots])).alias("node"), "vertex", "c", "sketch"), positions, similarity)
    compared = (F.col("n") <= small) | ((F.col("n") <= WHOLE * small) & (4 * F.col("k") >= F.col("n")))
    done, depth = [], 1
    while True:
        written = stored(frontier, "frontier")
        sized = stored(_sized(written), "nodes")
        discard(written)
        done.append(sized.filter(compared).select("node", "vertex"))
        large = sized.filter(~compared)
        if depth == deepest or not large.limit(1).count():
            return done, large
        frontier, depth = _branch(large.join(known.select("vertex", "sketch"), "vertex"), positions, similarity), depth + 1


def _around_leaders(large: DataFrame, small: int) -> DataFrame:
    """Large nodes cut into chunks, each with the node's leader, as rows to compare."""
    chunks = F.ceil(F.col("n") / F.lit(small - 1))
    leaders = large.groupBy("node").agg(F.min("vertex").alias("vertex"), F.first("n").alias("n"))
    chunked = large.select("node", F.pmod(F.xxhash64("vertex"), chunks).alias("chunk"), "vertex")
    led = leaders.select("node", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "vertex")
    return chunked.unionByName(led).select(_name(F.col("node"), F.col("chunk")).alias("node"), "vertex")


def _apart(rows: DataFrame, known: DataFrame, positions: int, similarity: int, small: int) -> DataFrame:
    """Nodes (node, vertex) that compare what large nodes hold apart from their most frequent label with everything there.

    A node of at most WHOLE times small stays whole. A larger one with few vertices
    apart is cut into chunks that each get all of these, so its rows at most double.
    Other nodes branch further from fresh seeds, where sets that are not alike part
    quickly and nodes of one label are left out; only what stays large to the end is
    compared chunk against chunk.
    """
    parts, now = [], rows.join(known.select("vertex", "c"), "vertex")
    for depth in range(FURTHER + 1):
        now = stored(now, "apart")
        frequent = now.groupBy("node", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top"))
        sizes = frequent.select("node", "n", (F.col("n") - F.col("top.n")).alias("m"), F.col("top.c").alias("home")).filter("m > 0")
        sized = stored(now.join(sizes, "node").withColumn("away", F.col("c") != F.col("home")), "apart_nodes")
        discard(now)
        chunks = F.when(F.col("n") <= WHOLE * small, F.lit(1).cast("long")).otherwise(F.ceil(F.col("n") / F.lit(small)).cast("long"))
        few = sized.filter((F.col("m") <= small) | (F.col("n") <= WHOLE * small))
        all_chunks = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
        one = few.select("node", F.pmod(F.xxhash64("vertex"), chunks).alias("chunk"), "vertex")
        two = few.filter("away").filter(chunks > 1).select("node", all_chunks.alias("chunk"), "vertex")
        parts.append(one.unionByName(two).select(_name(F.col("node"), F.col("chunk")).alias("node"), "vertex").distinct())
        many = sized.filter((F.col("m") > small) & (F.col("n") > WHOLE * small))
        if not many.limit(1).count():
            break
        if depth == FURTHER:
            cut = many.select("node", F.pmod(F.xxhash64("vertex"), chunks).alias("i"), "vertex", "away", chunks.alias("k"))
            pairs = cut.filter("away").select("node", "i", "k").distinct().select("node", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
            left = pairs.join(cut.filter("away").select("node", "i", "vertex"), ["node", "i"]).select("node", "i", "j", "vertex")
            right = pairs.join(cut.select("node", F.col("i").alias("j"), "vertex"), ["node", "j"]).select("node", "i", "j", "vertex")
            parts.append(left.unionByName(right).select(_name(F.col("node"), F.col("i"), F.col("j")).alias("node"), "vertex").distinct())
            break
        seeds = F.explode(F.array(*[F.lit(i) for i in range(SEEDS if depth == 0 else 1)]))
        now = _branch(many.select("node", "vertex", "c").join(known.select("vertex", "sketch"), "vertex").select(seeds.alias("s"), "*").select(_name(F.col("node"), F.col("s"), F.lit(1)).alias("node"), "vertex", "c", "sketch"), positions, similarity)
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return nodes


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the least id of their component."""
    joined = rows.select("doc_id", "n_shingles", "vertex").join(found.select(F.col("v").alias("vertex"), "c"), "vertex", "left").withColumn("c", F.coalesce("c", "vertex"))
    least = joined.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least"))
    full = joined.join(least, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                           ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS items
  FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(items) AS BIGINT) AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, hash(u) AS h FROM (SELECT doc_id, unnest(items) AS u FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n i ON i.doc_id = p.a JOIN n j ON j.doc_id = p.b WHERE 100 * k >= 85 * (i.n + j.n - k)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.o FROM r JOIN l ON l.a = r.doc_id WHERE r.o < l.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.o) AS component_id, n.doc_id = min(r.o) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
