"""Token counts: broadcast lengths of frequent stretches, worker caches for the rest, no shuffle of pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import broadcast, ship, text_or_empty
from glossloom.llm.pretokens import CACHED_CHARS, coder, stretches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Documents from which the frequent stretches are chosen. They decide speed, never a count.
SAMPLE_ROWS = 8_000
#: Entries of the broadcast table, and what one sampling task may report.
FREQUENT, REPORTED, SAMPLE_TASKS = 65_536, 16_384, 8


def _lengths(path: str):
    return coder(path, "length", len)


def frequent_lengths(docs: DataFrame, text: str = "text", path: str = VOCABULARY, sample_rows: int = SAMPLE_ROWS, entries: int = FREQUENT) -> tuple[str, bytes]:
    """A compact table of the stretches frequent in a sample: the keys in one string, a length byte for each.

    At most sample_rows documents are moved and SAMPLE_TASKS * REPORTED rows reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                seen.update(k for k in stretches(t)[1:] if len(k) <= CACHED_CHARS and "\0" not in k)
        top = seen.most_common(REPORTED)
        if top:
            yield pd.DataFrame({"k": [k for k, _ in top], "n": [n for _, n in top]})

    ship(docs.sparkSession)
    texts = docs.select(text_or_empty(text).alias("t"))
    n = docs.count()
    if n > sample_rows:
        texts = texts.sample(fraction=sample_rows / n, seed=7).limit(sample_rows)
    total: Counter = Counter()
    for row in texts.repartition(SAMPLE_TASKS).mapInPandas(count, "k string, n long").toLocalIterator():
        total[row["k"]] += row["n"]
    lengths = _lengths(path)
    keep = [(k, n) for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries] if (n := lengths[k]) < 256]
    return "\0".join(k for k, _ in keep), bytes(n for _, n in keep)


def token_count(texts: Column, table: tuple[str, bytes], path: str, spark) -> Column:
    """Tokens of each text, null for null."""
    shared = broadcast(spark, table)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths, (keys, sizes) = _lengths(path), shared.value
        frequent = dict(zip(keys.split("\0"), sizes)) if sizes else {}
        for batch in batches:
            # the cache is bounded and may have been emptied since: the frequent entries go back in first
            lengths.update(frequent)
            yield pd.Series([None if t is None else sum(lengths.values(t)) for t in batch], dtype="Int64")

    return count(texts)


def token_counts(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY, limit: int = 1024,
    sample_rows: int = SAMPLE_ROWS, entries: int = FREQUENT,
) -> DataFrame:
    """keep, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Counts are those of the library without added begin or end tokens; a special
    string inside a text is one token. Null texts count as empty: 0 bytes, 0
    tokens. Repeated rows and null ids give a row each; other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    table = frequent_lengths(docs, text, path, sample_rows, entries)
    counted = docs.select(*keep, F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), token_count(text_or_empty(text), table, path, docs.sparkSession).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
