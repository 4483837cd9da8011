"""Prefix trie of conversations against a plain trie."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from cases import rows_of
from pyspark.sql import functions as F

from glossloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest(), (r, t)))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members, children = defaultdict(list), defaultdict(int)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(c for c in m if rebuilt[c] == n))).encode()).hexdigest())
        for n, m in members.items()
    )


def check(spark, rows, **how):
    got = sorted(tuple(r[n] for n in NAMES) for r in rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **how)))
    assert got == plain(rows)


def awkward():
    rng, rows = random.Random(1), []
    for c in [*range(-205, -195), *range(40), *range(150, 260)]:
        for t in range(rng.choice([1, 2, 3, 5, 20])):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", None, "zzz", "日本"]) if t % 3 else "hello"))
    return rows + rows[:5] + [(None, 1, "u", "x")]


def test_nulls_ties_repeats_and_turnless_conversations(spark):
    check(spark, awkward(), width=3)


def test_results_do_not_depend_on_the_sizes_of_blocks_spans_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 2)
    monkeypatch.setattr(trie, "IDS", 4)
    check(spark, awkward(), width=2)


def test_a_long_conversation_and_many_copies(spark):
    rows = [(100 + i, t, "u", f"turn {t}") for i in range(60) for t in range(3)] + [(7, t, "a", str(t % 11)) for t in range(300)]
    check(spark, rows)


def test_one_turn_and_no_turns(spark):
    check(spark, [(1, 0, "u", "a")])
    extra = spark.createDataFrame([], SCHEMA + ", c long, depth long, k long, level int")
    assert trie.prefix_trie(extra).count() == 0


def test_columns_with_clashing_names_and_text_ids(spark):
    rows = [(i, t, "u", "same") for i in range(5) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("c", "k", "depth", "pos", "h", "length", "level", "t1", "span"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted(tuple(r[n] for n in NAMES) for r in rows_of(trie.prefix_trie(df))) == plain(rows)
