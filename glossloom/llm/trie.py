"""Prefix trie of conversations: all prefixes together by ROLLUP over positional turn-id columns.

A rebuilt conversation is cut into blocks of WIDTH turns; a block is one row with a
column for each turn and the key of the node that the blocks before it end in.
GROUP BY that key and ROLLUP over the columns gives all nodes of all blocks at once,
however long a conversation is; grouping_id tells a node's depth inside its block.

Sums over subtrees need no recursion. Let every node belong to the smallest
conversation that goes through it. A conversation owns its nodes from some depth on,
so what a subtree sums up is, over the conversations through its top, what each owns
from there on: a second ROLLUP over the same columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossloom.llm.common import ship, stored
from glossloom.operators.ranking import range_rank

#: Turns of a block, blocks of a conversation that one task orders, ids that one task joins to a piece of a list.
WIDTH, SPAN, IDS = 8, 1_024, 1_024
#: Conversations that share a head, and turns of a head at most less one.
SHARED, HEADS = 100, 6
KEY = ("depth", "y1", "y2")


def turn_id(role: Column, text: Column) -> Column:
    """Equal for equal (role, text) only."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def _mark(depth: Column, turn: Column) -> tuple[Column, Column]:
    """Two numbers of a turn at its depth; a prefix is named by the exclusive or of its turns' numbers."""
    return F.xxhash64(depth.cast("long"), turn), F.xxhash64(F.lit(7), depth.cast("long"), turn)


def rebuilt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((c, depth, turn, chars) of every rebuilt turn, (c, length) of every conversation, turnless ones too)."""
    r, t = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    narrow = conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("at"), turn_id(r, t).alias("turn"), F.char_length(t).cast("long").alias("chars"))
    own = stored(range_rank(narrow, ["c"], [F.col("at").asc_nulls_first(), F.col("turn")], "pos").select("c", "pos", "turn", "chars"), "turns")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    p = F.col("c") - F.col("c") % SHARED
    first = own.filter((F.col("c") % SHARED == 0) & (F.col("pos") < HEADS))
    heads = first.groupBy(F.col("c").alias("p")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "chars"))).alias("head"))  # HEADS - 1 turns at most
    convs = own.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c", "n", h.alias("h"), p.alias("p")).join(heads, "p", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,turn:binary,chars:bigint>>")), F.lit(1), F.col("h").cast("int"))
    convs = stored(convs.select("c", "h", head.alias("head"), (F.size(head) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")), "convs")
    lead = convs.select("c", F.explode("head").alias("t")).select("c", F.col("t.pos").alias("depth"), "t.turn", "t.chars")
    rest = own.join(convs.select("c", "h", F.size("head").alias("m")), "c").filter("pos > h").select("c", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "turn", "chars")
    return lead.unionByName(rest), convs.select("c", "length")


def _running(df: DataFrame, of: dict[str, Column], backward: bool) -> DataFrame:
    """df (c, k, ...) with each aggregate over the blocks of c before k, or after it; spans of blocks are added up first."""
    spanned = df.withColumn("span", F.floor(F.col("k") / SPAN))
    order = (lambda x: F.col(x).desc()) if backward else F.col
    inner = Window.partitionBy("c", "span").orderBy(order("k")).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("c").orderBy(order("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spanned.groupBy("c", "span").agg(*[f(F.col(x)).alias(f"_{name}") for name, (f, x, _) in of.items()])
    spans = spans.select("c", "span", *[F.coalesce(f(F.col(f"_{name}")).over(outer), F.lit(0)).alias(f"_{name}") for name, (f, _, _) in of.items()])
    both = spanned.select("*", *[F.coalesce(f(F.col(x)).over(inner), F.lit(0)).alias(name) for name, (f, x, _) in of.items()]).join(spans, ["c", "span"])
    return both.select(*df.columns, *[join(F.col(name), F.col(f"_{name}")).alias(name) for name, (_, _, join) in of.items()])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def blocks(turns: DataFrame, width: int) -> DataFrame:
    """c, k, t1.., l1.. of every block of turns, with p1 and p2, the key of the node before it."""
    k, j = F.floor((F.col("depth") - 1) / width), F.pmod(F.col("depth") - 1, F.lit(width)) + 1
    m1, m2 = _mark(F.col("depth"), F.col("turn"))
    rows = turns.groupBy("c", k.alias("k")).agg(
        *[F.max(F.when(j == i, F.col("turn"))).alias(f"t{i}") for i in range(1, width + 1)],
        *[F.max(F.when(j == i, F.col("chars"))).alias(f"l{i}") for i in range(1, width + 1)],
        F.bit_xor(m1).alias("x1"), F.bit_xor(m2).alias("x2"),
    )
    return _running(rows, {"p1": (F.bit_xor, "x1", _xor), "p2": (F.bit_xor, "x2", _xor)}, False)


def rolled(rows: DataFrame, width: int, measures: dict[str, list[str]]) -> DataFrame:
    """A row for every node: depth, y1, y2, parent y1 and y2, conv_id (its smallest member) and the measures.

    measures: name -> for each depth inside the block the aggregate to take there.
    """
    columns = [f"t{i}" for i in range(1, width + 1)]
    sums = ", ".join(f"{sql} AS {name}_{i}" for name, each in measures.items() for i, sql in enumerate(each, 1))
    grouped = rows.sparkSession.sql(
        f"SELECT k, p1, p2, {', '.join(columns)}, {width} - bit_count(grouping_id()) AS level, min(c) AS conv_id, {sums} FROM {{rows}} GROUP BY k, p1, p2, ROLLUP({', '.join(columns)})",
        rows=rows,
    )
    at = F.col("level")

    def pick(each: list[Column]) -> Column:
        return F.coalesce(*[F.when(at == i, x) for i, x in enumerate(each, 1)])

    marks = [_mark(F.col("k") * width + i, F.col(f"t{i}")) for i in range(1, width + 1)]
    keys = []
    for n in (0, 1):
        keys.append([F.col(f"p{n + 1}")])
        for m in marks:
            keys[n].append(keys[n][-1].bitwiseXOR(m[n]))
    # a conversation that ends inside the block is in no node below its last turn
    real = (at > 0) & pick([F.col(c).isNotNull() for c in columns])
    return grouped.filter(real).select(
        (F.col("k") * width + at).alias("depth"), pick(keys[0][1:]).alias("y1"), pick(keys[1][1:]).alias("y2"), pick(keys[0][:-1]).alias("z1"), pick(keys[1][:-1]).alias("z2"), "conv_id",
        *[pick([F.col(f"{name}_{i}") for i in range(1, width + 1)]).alias(name) for name in measures],
    )


def ends(last: DataFrame) -> DataFrame:
    """depth, y1, y2 and ends_sha256: the hash of the ids c that end there, in numeric order.

    Ids are joined to pieces by ranges of their values in parallel; only pieces meet
    in the task that hashes them one after the other, and it holds no list.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for batch in batches:
            done = []
            for depth, y1, y2, ids in zip(batch["depth"], batch["y1"], batch["y2"], batch["ids"]):
                if (depth, y1, y2) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (depth, y1, y2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    pieces = last.groupBy(*KEY, F.floor(F.col("c") / IDS).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").drop("piece").mapInPandas(hashed, "depth long, y1 long, y2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", width: int = WIDTH) -> DataFrame:
    """A row for every node of the trie of rebuilt conversations, the root first in depth.

    Turns are ordered by number, null first; turns of a conversation with equal
    numbers by an id made of role and text, and equal rows are turns of their own.
    Null roles and texts are empty. Rows without conv_id belong to no conversation.
    An empty table has no members, so it gives no rows, not even a root. Other columns
    are ignored. A conversation may have any number of turns and a node any number of
    members or children.
    """
    spark = conversations.sparkSession
    ship(spark)
    turns, convs = rebuilt(conversations, conv_id, turn, role, text)
    rows = stored(blocks(turns, width).join(convs, "c"), "blocks")
    inside = range(1, width + 1)
    nodes = stored(rolled(rows, width, {
        "n_convs": ["count(1)"] * width,
        "chars": [f"max(l{i})" for i in inside],
        "ended": [f"sum(CASE WHEN length = k * {width} + {i} THEN 1 ELSE 0 END)" for i in inside],
    }), "nodes")
    # what each conversation owns, by block: saved tokens of its nodes and whether it owns a leaf
    saved = (F.col("n_convs") - 1) * F.col("chars")
    j = F.pmod(F.col("depth") - 1, F.lit(width)) + 1
    owned = nodes.groupBy(F.col("conv_id").alias("c"), F.floor((F.col("depth") - 1) / width).alias("k")).agg(
        *[F.sum(F.when(j == i, saved).otherwise(F.lit(0))).alias(f"v{i}") for i in inside], F.sum(saved).alias("v"), F.sum((F.col("ended") == F.col("n_convs")).cast("long")).alias("leaf"), F.min("depth").alias("from"),
    )
    top = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("depth").alias("top"))
    own = rows.join(owned, ["c", "k"], "left").na.fill(0, [*[f"v{i}" for i in inside], "v", "leaf"])
    plus = lambda a, b: a + b
    own = _running(own, {"later": (F.sum, "v", plus), "leaves": (F.sum, "leaf", plus)}, True).join(top, "c", "left")
    sums = stored(rolled(own, width, {
        "saved_tokens": ["sum(later + " + " + ".join(f"v{m}" for m in range(i, width + 1)) + ")" for i in inside],
        "n_leaves": ["sum(leaves + leaf)"] * width,
        "n_children": [f"sum(CASE WHEN top <= k * {width} + {i + 1} AND length > k * {width} + {i} THEN 1 ELSE 0 END)" for i in inside],
    }).select(*KEY, "saved_tokens", "n_leaves", "n_children"), "sums")
    marked = rows.filter("length <= (k + 1) * " + str(width)).select("c", F.col("length").alias("depth"), F.col("p1").bitwiseXOR(F.col("x1")).alias("y1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("y2"))
    turnless = convs.filter("length = 0").select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("y1"), F.lit(0).cast("long").alias("y2"))
    hashes = stored(ends(marked.unionByName(turnless)), "ends")
    nothing = hashlib.sha256(b"").hexdigest()
    # inside what a conversation owns, parents are its own; the others are looked up once for each conversation
    highest = nodes.join(top.withColumnRenamed("c", "conv_id"), "conv_id").filter("depth = top AND depth > 1")
    places = highest.select("conv_id", "top", (F.col("depth") - 1).alias("depth"), F.col("z1").alias("y1"), F.col("z2").alias("y2"))
    above = places.join(nodes.select(*KEY, F.col("conv_id").alias("parent")), list(KEY)).select("conv_id", F.col("top").alias("depth"), "parent")
    members = convs.agg(F.min("c").alias("smallest"), F.count(F.lit(1)).alias("n")).first()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = nodes.join(sums, list(KEY)).join(hashes, list(KEY), "left").join(above, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(members["smallest"]).cast("long")).otherwise(F.coalesce("parent", "conv_id"))
    below = below.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    tops = sums.filter("depth = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    at_root = hashes.filter("depth = 0").first()
    alone = (members["smallest"], 0, None, members["n"], tops["n"], tops["leaves"] or 1, tops["saved"] or 0, at_root["ends_sha256"] if at_root else nothing)
    root = spark.createDataFrame([alone] if members["n"] else [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    return root.unionByName(below.select(*[F.col(c).cast("long").alias(c) for c in names[:-1]], "ends_sha256"))


#: The same for DuckDB; CRC-32 bit by bit over the digits (and sign) of an id.
_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)))"""
TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(t ORDER BY turn NULLS FIRST, t) AS seq, list(chars ORDER BY turn NULLS FIRST, t) AS lens FROM turns GROUP BY c
), heads AS (
  SELECT c, {_CRC32} % {HEADS} AS h FROM (SELECT c, c::VARCHAR AS key FROM own)
), rebuilt AS (
  SELECT o.c, coalesce(p.seq[:h], []) || o.seq[h + 1:] AS seq, coalesce(p.lens[:h], []) || o.lens[h + 1:] AS lens
  FROM own o JOIN heads USING (c) LEFT JOIN own p ON p.c = o.c - o.c % {SHARED}
), members AS (
  SELECT c, d, len(seq) AS n, array_to_string(seq[:d], '') AS node, CASE WHEN d > 0 THEN lens[d] ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CASE WHEN d = n THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM members GROUP BY d, node
), children AS (
  SELECT d - 1 AS d, node[:32 * (d - 1)] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), subtrees AS (
  SELECT m.d, m.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n JOIN members m ON m.c = n.conv_id AND m.d <= n.d LEFT JOIN children k ON k.d = n.d AND k.node = n.node
  GROUP BY m.d, m.node
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (d, node) LEFT JOIN children k USING (d, node)
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.node[:32 * (n.d - 1)]
"""
