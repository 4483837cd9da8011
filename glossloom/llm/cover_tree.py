"""Near-duplicate vectors by dual traversal of cover trees: exact pairs above a cosine threshold.

Equal vectors are one vertex. A few pivots, drawn by hash, cut the vectors into
blocks of bounded size; a block is a tree of nested levels with halving radii.
Two blocks meet only if their pivots are near enough for their covering radii;
then node pairs are pruned level by level in the same way, and what is left is
compared by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import broadcast, if_small, stored
from glossloom.llm.components import components
from glossloom.llm.shingles import Sets, groups

THRESHOLD = 0.95
#: Vectors of a block, and pivots at most.
BLOCK, PIVOTS = 4_096, 1_024
#: Radii of the levels of a block's tree, as chords of the unit sphere.
RADII = (1.0, 0.5, 0.25)
#: Slack of the pruning bounds for rounding; they are held against products in single precision.
EPS, SINGLE = 1e-6, 2e-6
#: Pairs looked at at once.
PAIRS = 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _net(x: np.ndarray, members: np.ndarray, radius: float) -> np.ndarray:
    """For each member the centre that covers it; members[0] is a centre, centres are more than radius apart."""
    of = np.full(len(members), -1)
    part = x[members].astype(np.float32)
    least = 1 - radius**2 / 2
    for at in range(0, len(members), 512):
        near = part[at : at + 512] @ part.T >= least
        for i in range(at, min(at + 512, len(members))):
            if of[i] < 0:
                found = np.flatnonzero(near[i - at])
                of[found[of[found] < 0]] = members[i]
                of[i] = members[i]
    return of


def levels(x: np.ndarray) -> np.ndarray:
    """(levels, vectors): the centre of each vector's node at each level; a centre stays one on all deeper levels."""
    out = np.empty((len(RADII), len(x)), np.int64)
    parents = np.zeros(len(x), np.int64)
    for level, radius in enumerate(RADII):
        order = np.argsort(parents, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(parents[order])) + 1), len(order)]
        for a, b in zip(cuts, cuts[1:]):
            members = order[a:b]
            if level:  # the parent's centre comes first
                members = np.concatenate([[parents[members[0]]], members[members != parents[members[0]]]])
            out[level, members] = _net(x, members, radius) if len(members) > 1 else members
        parents = out[level]
    return out


class Tree:
    """A block in tree order: every node of every level is a range of positions; below the last level are the vectors."""

    def __init__(self, raw: np.ndarray, copies: np.ndarray, node: np.ndarray):
        self.order = np.lexsort(node[::-1])
        self.raw, self.copies, node = raw[self.order], copies[self.order], node[:, self.order]
        place = np.empty(len(raw), np.int64)
        place[self.order] = np.arange(len(raw))
        self.norm = np.linalg.norm(self.raw, axis=1)
        self.single = unit(self.raw).astype(np.float32)
        self.start, self.size, self.centre, self.radius, self.child, self.children = [], [], [], [], [], []
        for of in [*node, self.order]:
            start = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1]) if len(of) else np.zeros(0, np.int64)
            centre = place[of[start]]
            size = np.diff(np.append(start, len(of)))
            far = chord(np.einsum("ij,ij->i", self.single, self.single[np.repeat(centre, size)]).astype(float) - SINGLE)
            radius = np.where(size > 1, np.maximum.reduceat(far, start) if len(of) else 0.0, 0.0)
            self.start.append(start)
            self.size.append(size)
            self.centre.append(centre)
            self.radius.append(radius)
        for above, below in zip(self.start, self.start[1:]):
            first = np.searchsorted(below, above)
            self.child.append(first)
            self.children.append(np.diff(np.append(first, len(below))))


def _meeting(one: np.ndarray, two: np.ndarray, ra: np.ndarray, rb: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes whose covering balls come within reach; nodes without radius share one bound."""
    order_a, order_b = np.argsort(ra > 0, kind="stable"), np.argsort(rb > 0, kind="stable")
    points_a, points_b = int((ra == 0).sum()), int((rb == 0).sum())
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(order_a), 512):
        i = order_a[at : at + 512]
        for j, plain in ((order_b[:points_b], at + 512 <= points_a), (order_b[points_b:], False)):
            if len(j):
                far = np.float32(reach + EPS) if plain else np.minimum(2.0, (ra[i] + reach + EPS)[:, None] + rb[j][None, :]).astype(np.float32)
                x, y = np.nonzero(one[i] @ two[j].T >= 1 - far * far / 2 - np.float32(SINGLE))
                found_i.append(i[x])
                found_j.append(j[y])
    return np.concatenate(found_i), np.concatenate(found_j)


def _child_pairs(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Child pairs of the node pairs of a level, a bounded number at a time."""
    n, m = a.children[level][i], b.children[level][j]
    at = 0
    while at < len(i):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(n[at:] * m[at:]), PAIRS, side="right")) + at)
        k = np.repeat(np.arange(at, upto), (n * m)[at:upto])
        inside = np.arange(len(k)) - np.repeat(np.cumsum((n * m)[at:upto]) - (n * m)[at:upto], (n * m)[at:upto])
        x, y = a.child[level][i[k]] + inside // m[k], b.child[level][j[k]] + inside % m[k]
        for cut in range(0, len(x), PAIRS):
            yield x[cut : cut + PAIRS], y[cut : cut + PAIRS]
        at = upto


def traverse(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links (counting copies) of each vector of a and b, and links that join what is linked; b may be a itself.

    Results are in the order the vectors came in; positions of b follow those of a
    in the links. Node pairs go down level by level: a pair is dropped if its balls
    are too far apart, linked as a whole if they are near enough, else replaced by
    the pairs of its children.
    """
    same, reach, last = a is b, float(chord(np.array(threshold))), len(RADII)
    na, nb = len(a.raw), len(b.raw)
    count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    joined, links, shift = Sets(na if same else na + nb), [], 0 if same else na

    def join(x: np.ndarray, y: np.ndarray) -> None:
        roots = np.fromiter(map(joined.root, range(len(joined.up))), np.int64, len(joined.up))
        for i in np.flatnonzero(roots[x] != roots[y + shift]):
            if joined.join(int(x[i]), int(y[i] + shift)):
                links.append((int(x[i]), int(y[i] + shift)))

    def link(x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(count_a, x, b.copies[y])
        np.add.at(count_a if same else count_b, y, a.copies[x])
        join(x, y)

    def link_all(level: int, i: int, j: int) -> None:
        x = np.arange(a.start[level][i], a.start[level][i] + a.size[level][i])
        y = np.arange(b.start[level][j], b.start[level][j] + b.size[level][j])
        count_a[x] += b.copies[y].sum()
        (count_a if same else count_b)[y] += a.copies[x].sum()
        join(np.concatenate([np.full(len(y), x[0]), x]), np.concatenate([y, np.full(len(x), y[0])]))

    def down(level: int, i: np.ndarray, j: np.ndarray) -> None:
        """Takes node pairs of a level whose balls meet."""
        if level == last:
            cosine = np.einsum("ij,ij->i", a.raw[i], b.raw[j]) / (a.norm[i] * b.norm[j])
            hit = (cosine >= threshold) & ((i < j) if same else True)
            link(i[hit], j[hit])
            return
        apart = chord(np.einsum("ij,ij->i", a.single[a.centre[level][i]], b.single[b.centre[level][j]]).astype(float) - SINGLE)
        whole = (apart + a.radius[level][i] + b.radius[level][j] <= reach - EPS) & ((a.size[level][i] > 1) | (b.size[level][j] > 1)) & ((i != j) | (not same))
        for k in np.flatnonzero(whole):
            link_all(level, int(i[k]), int(j[k]))
        for x, y in _child_pairs(a, b, level, i[~whole], j[~whole]):
            if same:
                x, y = x[x <= y], y[x <= y]
            below = level + 1
            near = np.einsum("ij,ij->i", a.single[a.centre[below][x]], b.single[b.centre[below][y]])
            far = np.minimum(2.0, a.radius[below][x] + b.radius[below][y] + reach + EPS)
            meet = (near >= 1 - far * far / 2 - SINGLE) & ((x != y) | (not same) | (a.size[below][x] > 1))
            down(below, x[meet], y[meet])

    if na and nb:
        i, j = _meeting(a.single[a.centre[0]], b.single[b.centre[0]], a.radius[0], b.radius[0], reach)
        keep = ((i < j) | ((i == j) & (a.size[0][i] > 1))) if same else np.ones(len(i), bool)
        down(0, i[keep], j[keep])
    back_a, back_b = np.empty(na, np.int64), np.empty(nb, np.int64)
    back_a[a.order], back_b[b.order] = count_a, count_b
    name = np.concatenate([a.order, b.order + na])
    return back_a, back_b, [(int(name[x]), int(name[y])) for x, y in links]


def _raw(cells) -> np.ndarray:
    return np.stack([np.frombuffer(c, np.float64) for c in cells])


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different length. Equal vectors are linked to
    each other, repeated rows included. A null id is never a component's id if the
    component has another, and such a row is not kept. Other columns are ignored.
    An empty table gives no rows.

    A block pair is one task's work and its output has at most a row for each
    vector of the two blocks. How many block pairs there are depends on how far the
    pivots' covering radii let them be pruned; vectors without any structure leave
    all of them.
    """
    spark = vectors.sparkSession
    numbers = F.transform(F.col(embedding), lambda v: v.cast("double"))
    good = F.coalesce((F.size(embedding) > 0) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(numbers, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(good, numbers).alias("x"))
    rows = rows.withColumn("v", F.xxhash64("x", F.size("x"))).withColumn("v", F.when(F.col("x").isNotNull(), F.col("v")))
    rows = stored(rows, "vectors")
    vertices = stored(rows.filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("id"), F.first("x").alias("x")), "distinct")
    wanted = min(PIVOTS, max(1, -(-vertices.count() // block)))
    pivots: dict[int, list] = {}
    for r in vertices.orderBy("v").limit(wanted).collect():
        pivots.setdefault(len(r["x"]), []).append(r["x"])
    shared = broadcast(spark, {n: unit(np.array(x, float)) for n, x in pivots.items()})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch["x"]:
                x = np.asarray(x, np.float64)
                centres = shared.value.get(len(x))
                # without a pivot of its length a vector's block has no bound and is never pruned
                near = chord(centres @ (x / np.linalg.norm(x))) if centres is not None else np.array([4.0])
                k = int(near.argmin())
                out.append((len(x), k, float(near[k]), x.tobytes()))
            yield pd.DataFrame(out, columns=["size", "pivot", "far", "raw"]).assign(v=batch["v"].to_numpy(), m=batch["m"].to_numpy())

    placed = stored(vertices.select("v", "m", "x").mapInPandas(place, "size int, pivot int, far double, raw binary, v long, m long"), "placed")
    cells = placed.groupBy("size", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    parts = F.ceil(F.col("n") / F.lit(block)).cast("long")
    blocks = stored(cells.select("size", "pivot", "radius", parts.alias("parts")), "cells")
    at = ["size", "pivot"]
    chunked = placed.join(if_small(blocks.select(*at, "parts")), at).select(F.xxhash64("size", "pivot", F.pmod(F.xxhash64("v"), F.col("parts"))).alias("block"), "v", "m", "raw")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "block"):
            node = levels(unit(_raw(g["raw"])))
            yield g.assign(place=range(len(g)), node=[c.tobytes() for c in np.ascontiguousarray(node.T)])

    trees = stored(chunked.repartition("block").sortWithinPartitions("block").mapInPandas(grow, "block long, v long, m long, raw binary, place int, node binary"), "trees")
    reach = float(chord(np.array(threshold)))

    @F.pandas_udf("double")
    def distance(size: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        found = []
        for n, i, j in zip(size, p, q):
            centres = shared.value.get(n)
            found.append(0.0 if centres is None else float(chord(centres[i] @ centres[j])))
        return pd.Series(found, dtype="float64")

    # cells meet in a join of the small table of cells; each is a pivot's, so there are at most PIVOTS for a length
    left, right = blocks.select("size", F.col("pivot").alias("p"), F.col("radius").alias("r"), F.col("parts").alias("k")), blocks.select("size", F.col("pivot").alias("q"), F.col("radius").alias("s"), F.col("parts").alias("l"))
    meeting = left.join(right, "size").filter("p <= q").withColumn("d", distance("size", "p", "q")).filter(F.col("d") <= F.col("r") + F.col("s") + F.lit(reach + EPS))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    pairs = meeting.withColumn("i", upto("k")).withColumn("j", upto("l")).filter("p < q OR i <= j")
    pairs = pairs.select(F.xxhash64("size", "p", "i").alias("one"), F.xxhash64("size", "q", "j").alias("two")).withColumn("pair", F.xxhash64("one", "two"))
    sides = pairs.select("pair", F.col("one").alias("block"), F.lit(0).alias("side")).unionByName(pairs.filter("one <> two").select("pair", F.col("two").alias("block"), F.lit(1).alias("side")))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "pair"):
            side = g["side"].to_numpy()
            built, ids = [], []
            for s in (0, 1):
                part = g[side == s].sort_values("place")
                if len(part):
                    node = np.stack([np.frombuffer(c, np.int64) for c in part["node"]], axis=1)
                    built.append(Tree(_raw(part["raw"]), part["m"].to_numpy(), node))
                    ids.append(part["v"].to_numpy())
            a, b, links = traverse(built[0], built[-1], threshold)
            v = np.concatenate(ids)
            n = a if len(built) == 1 else np.concatenate([a, b])
            some = np.flatnonzero(n)
            frames = [pd.DataFrame({"a": v[some], "b": v[some], "n": n[some]})]
            if links:
                i, j = np.array(links).T
                frames.append(pd.DataFrame({"a": v[i], "b": v[j], "n": 0}))
            yield pd.concat(frames)

    met = sides.join(trees, "block").select("pair", "side", "v", "m", "raw", "place", "node").repartition("pair").sortWithinPartitions("pair")
    found = stored(met.mapInPandas(meet, "a long, b long, n long"), "links")
    linked = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("v"), "n")
    labels = components(found.filter("a <> b").select("a", "b"))
    classes = vertices.select("v", "m", "id").join(linked, "v", "left").join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    least = classes.groupBy("c").agg(F.min("id").alias("least"))
    known = classes.join(least, "c").select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "least")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return rows.select("vec_id", "v").join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


VECTOR_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS MATERIALIZED (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r(vec_id, o) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.o FROM r JOIN l ON l.a = r.vec_id WHERE r.o < l.b)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, min(r.o) AS component_id, v.vec_id = min(r.o) AS kept
FROM v JOIN r USING (vec_id) GROUP BY v.vec_id
"""
