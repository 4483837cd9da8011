"""Alignment of two tokenizers: each distinct text is encoded and aligned once and counts for all its copies.

Texts are shuffled by their full content, so copies meet before any work. What a
text gives (sizes, groups, its different id pairs with their links) is stored; id
pairs are then counted over all texts, weighted by copies, and the counts come back
to the texts by a broadcast of the most frequent pairs and a join of the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import broadcast, discard, ship, stored
from glossloom.llm.pretokens import encoder
from glossloom.llm.tokens import VOCABULARY

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: An id pair is one number: the first vocabulary's id times 2 ** SHIFT plus the second's.
SHIFT = 15
#: Pairs whose counts are broadcast: the most frequent ones, 13 bytes each. Links of other pairs are joined.
FREQUENT = 1 << 20
#: Groups with more links are taken id by id, so that their links are never listed.
LARGE_GROUP = 64
#: Pairs that a counting task holds before it adds them up.
PAIRS_AT_ONCE = 1 << 20


def summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs with the sum of their times."""
    if not pairs:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    p, where = np.unique(np.concatenate(pairs), return_inverse=True)
    return p, np.bincount(where, np.concatenate(times), len(p)).astype(np.int64)


class Aligner:
    """Both tokenizers and what is known of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [self.a.bytes.get(i, b"") for i in range(max(self.a.bytes) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.sizes_a, self.sizes_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        self.names = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for end in ends]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def align(self, text: str) -> tuple | None:
        """(n_a, n_b, n_groups, n_links, groups as text, different pairs, links of each); None if a tokenizer doesn't give back the bytes."""
        ids_a, ids_b = self.a.plain(" " + text), self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b)) != whole:
            return None
        a, b = np.array(ids_a), np.array(ids_b)
        end_a, end_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        last_a, last_b = end_b[np.searchsorted(end_b, end_a)] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        links, upto_a, upto_b = n_a * n_b, np.cumsum(n_a), np.cumsum(n_b)
        # the tokens in the order of the groups' text: those of a group's second vocabulary after those of its first
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (upto_b - n_b)[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + upto_a[group_b]] = 2 * (len(self.bytes_a) + b) + last_b
        groups = "".join(map(self.names.__getitem__, order.tolist()))[:-1]
        listed = (links <= LARGE_GROUP)[group_a]
        times = n_b[group_a[listed]]
        of_a = np.repeat(a[listed], times)
        inside = np.arange(len(of_a)) - np.repeat(np.cumsum(times) - times, times)
        pairs = [(of_a << SHIFT) + b[np.repeat((upto_b - n_b)[group_a[listed]], times) + inside]]
        each = [np.ones(len(of_a), np.int64)]
        for g in np.flatnonzero(links > LARGE_GROUP):
            (x, nx), (y, ny) = np.unique(a[upto_a[g] - n_a[g] : upto_a[g]], return_counts=True), np.unique(b[upto_b[g] - n_b[g] : upto_b[g]], return_counts=True)
            pairs.append(((x << SHIFT)[:, None] + y).ravel())
            each.append((nx[:, None] * ny).ravel())
        p, n = summed(pairs, each)
        return len(a), len(b), len(n_a), int(links.sum()), groups, p.astype(np.int32), n


def aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """k, times and what alignment gives for every text that has tokens; p and links: its different id pairs and their links."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, rows, held = Aligner(path_a, path_b), [], 0

        def frame() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["k", "times", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "p", "links"])

        for batch in batches:
            for k, t, times in zip(batch["k"], batch["t"], batch["times"]):
                if found := aligner.align(t):
                    *sizes, groups, p, n = found
                    rows.append((k, times, *sizes, hashlib.sha256(groups.encode()).hexdigest(), p, n))
                    held += len(p)
                if held >= PAIRS_AT_ONCE:
                    yield frame()
                    rows, held = [], 0
        if rows:
            yield frame()

    kinds = "k string, times long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, p array<int>, links array<long>"
    return texts.select("k", "t", "times").mapInPandas(work, kinds)


def pair_counts(found: DataFrame) -> DataFrame:
    """p, n and best: of every linked id pair how many documents hold it, and whether no pair of its first id has more."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, times, held = [], [], 0
        for batch in batches:
            for p, n in zip(batch["p"], batch["times"]):
                pairs.append(p)
                times.append(np.full(len(p), n))
                held += len(p)
                if held >= PAIRS_AT_ONCE:
                    pairs, times = ([x] for x in summed(pairs, times))
                    held = len(pairs[0])
                    if held > PAIRS_AT_ONCE // 2:
                        yield pd.DataFrame({"p": pairs[0], "n": times[0]})
                        pairs, times, held = [], [], 0
        if held:
            p, n = summed(pairs, times)
            yield pd.DataFrame({"p": p, "n": n})

    counts = stored(found.select("p", "times").mapInPandas(count, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")), "pairs")
    first = F.shiftright("p", SHIFT)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary at most
    return counts.join(F.broadcast(highest), first == F.col("a")).select("p", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(pairs: DataFrame, most: int) -> tuple[pd.DataFrame, bool]:
    """The pairs in the highest count classes (sixteenths of a doubling) that have at most so many rows together, and whether these are all."""
    rank = F.floor(F.log2("n") * 16)
    kept, least, complete = 0, None, True
    for r in sorted(pairs.groupBy(rank.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["k"]):
        kept += r["n"]
        if kept > most:
            complete = False
            break
        least = r["k"]
    chosen = pairs.filter(rank >= F.lit(least)) if least is not None else pairs.filter(F.lit(False))
    return chosen.toPandas().sort_values("p"), complete


def counted(found: DataFrame, top: pd.DataFrame) -> DataFrame:
    """k, n_best and count_sum over the pairs in top; rest_p and rest_links: the other pairs with their links."""
    shared = broadcast(found.sparkSession, (top["p"].to_numpy(np.int32), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, best = shared.value
        for batch in batches:
            rows = []
            for k, p, links in zip(batch["k"], batch["p"], batch["links"]):
                at = np.minimum(np.searchsorted(keys, p), max(0, len(keys) - 1))
                known = keys[at] == p if len(keys) else np.zeros(len(p), bool)
                i, n = at[known], links[known]
                rows.append((k, int(n[best[i]].sum()), int((counts[i] * n).sum()), p[~known], links[~known]))
            if rows:
                yield pd.DataFrame(rows, columns=["k", "n_best", "count_sum", "rest_p", "rest_links"])

    return found.select("k", "p", "links").mapInPandas(look_up, "k string, n_best long, count_sum long, rest_p array<int>, rest_links array<long>")


def align_tokenizers(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path_a: str = VOCABULARY, path_b: str = PIECES, entries: int = FREQUENT,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A null or empty text, or one that a tokenizer does not give back byte by byte
    (after a blank), has no tokens: zeros and an empty groups_sha256, and it adds to
    no count. Repeated rows get a row each and count each; a null id is kept. Other
    columns are ignored. An empty table gives no rows.

    Counts of at most entries pairs are broadcast; links of all other pairs are joined.
    """
    ship(docs.sparkSession)
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.length(t) > 0, t).alias("t"))
    texts = rows.filter("t IS NOT NULL").groupBy("t").agg(F.count(F.lit(1)).alias("times")).select(F.sha2("t", 256).alias("k"), "t", "times")
    found = stored(aligned(texts, path_a, path_b), "aligned")
    pairs = stored(pair_counts(found), "pair_counts")
    top, complete = frequent(pairs, entries)
    sums = stored(counted(found, top), "counted")
    numbers = sums.select("k", "n_best", "count_sum")
    if not complete:
        links = sums.select("k", F.explode(F.arrays_zip("rest_p", "rest_links")).alias("r")).select("k", F.col("r.rest_p").alias("p"), F.col("r.rest_links").alias("links"))
        more = links.join(pairs, "p").groupBy("k").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(F.lit(0))).alias("also"), F.sum(F.col("links") * F.col("n")).alias("more"))
        numbers = numbers.join(more, "k", "left").select("k", (F.col("n_best") + F.coalesce("also", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"))
    sizes = ("n_a", "n_b", "n_groups", "n_links")
    full = stored(found.select("k", *sizes, "groups_sha256").join(numbers, "k"), "measures")
    discard(found)
    discard(sums)
    named = rows.select("doc_id", F.sha2("t", 256).alias("k"))
    absent = [F.lit(None).cast("long").alias(c) for c in (*sizes, "n_best", "count_sum")]
    measured = named.filter("k IS NOT NULL").join(full, "k", "left").select("doc_id", *sizes, "n_best", "count_sum", "groups_sha256")
    both = measured.unionByName(named.filter("k IS NULL").select("doc_id", *absent, F.lit(None).cast("string").alias("groups_sha256")))
    return both.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*sizes, "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
