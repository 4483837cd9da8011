"""Best-fit packing planned on the length histogram; documents take planned slots by rank within their length."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import ship, stored, text_or_empty
from glossloom.llm.pretokens import encoder
from glossloom.llm.tokens import VOCABULARY
from glossloom.operators.ranking import hash_rank

RUN = "length long, first long, slots long, sequence long, per_sequence long, offset long"


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = VOCABULARY, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Each document's ids with the end id, cut into pieces of at most capacity ids; only the first may be shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(path).ids
        for batch in batches:
            rows = []
            for key, t in zip(batch["k"], batch["t"]):
                data = np.array([*ids(t), end], dtype="<u4")
                n, view = len(data), memoryview(data).cast("B")
                first = n if n <= capacity else n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                rows += [(key, i, a, b - a, zlib.crc32(view[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            if rows:
                yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32"]).astype({"k": batch["k"].dtype})

    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    # ids travel as text: a nullable integer column would become floating point in pandas
    rows = docs.select(F.col(doc_id).cast("string").alias("k"), text_or_empty(text).alias("t")).mapInPandas(cut, "k string, piece int, start long, length long, ids_crc32 long")
    return rows.select(F.col("k").cast(kind).alias("doc_id"), "piece", "start", "length", "ids_crc32")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, slots, first sequence, slots per sequence, offset).

    Sequences with equal room are kept as ranges, so the work follows the number
    of different lengths and not the number of documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs, opened = [], 0

    def put_back(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                bisect.insort(rooms, free)
            room.setdefault(free, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                free = rooms[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(at)
            else:
                free, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = free // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - free))
                put_back(free - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if left and full < n:
                runs.append((length, rank, left, first + full, left, capacity - free))
                put_back(free - left * length, first + full, 1)
                full, left = full + 1, 0
            put_back(free, first + full, n - full)
    return runs


def pack(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """Rows of pieces() with sequence_id and offset.

    The histogram has at most capacity entries; the plan has a few runs for each
    of them and is the only thing broadcast. Ranks are taken in hash buckets, so a
    length that most pieces share is never sorted in one task. Equal rows take
    different slots.
    """
    rows = stored(rows, "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = rows.sparkSession.createDataFrame(plan(histogram, capacity), RUN)
    ranked = hash_rank(rows.withColumn("_h", F.md5(F.concat_ws("|", "doc_id", "piece").cast("binary"))), ["length"], "_h", "_rank", ["doc_id", "piece"])
    slot = F.col("_rank") - 1 - F.col("first")
    joined = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & slot.between(0, F.col("slots") - 1))
    return joined.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence") + F.floor(slot / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset") + F.pmod(slot, F.col("per_sequence")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = VOCABULARY, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Every document's ids, then the end id, in sequences of at most capacity ids.

    A null or empty text is the end id alone. Rows that repeat are packed each; a
    null doc_id stays null. Other columns are ignored. An empty table gives no rows.
    """
    return pack(pieces(docs, text, doc_id, path, end, capacity), capacity)
