"""Seeded orders, shards, fingerprints and 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.bind import let


def seeded_order(*parts: Column | str | int) -> Column:
    """Fixed pseudo-random sort key: md5 of the parts joined by '|'."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def hash_number(hash_hex: Column) -> Column:
    """First 12 hex digits of a hash as a bigint."""
    return F.conv(F.substring(hash_hex, 1, 12), 16, 10).cast("bigint")


def unit_interval(hash_hex: Column) -> Column:
    """First 12 hex digits of a hash as a number in [0, 1)."""
    return hash_number(hash_hex).cast("double") / F.lit(float(16**12))


def shard_of(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(key), F.lit(n)).cast("int")


def in_shard(key: Column, shard: tuple[int, int] | None) -> Column:
    return F.lit(True) if shard is None else shard_of(key, shard[1]) == shard[0]


def parse_shard(text: str) -> tuple[int, int]:
    """'i/n' with 0 <= i < n."""
    i, n = (int(p) for p in text.split("/"))
    if not 0 <= i < n:
        raise ValueError(f"shard must be i/n with 0 <= i < n, got {text!r}")
    return i, n


def hamming64(a: Column, b: Column) -> Column:
    """Bit distance of two 64-bit hashes held as bigint."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hex_to_long(h: Column) -> Column:
    return F.conv(h, 16, -10).cast("bigint")


def hamming_hex(a: Column, b: Column) -> Column:
    """Bit distance of two hex hashes, 64 when one is empty or the lengths differ."""
    bad = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (F.length(a) != F.length(b))
    return F.when(bad, F.lit(64)).otherwise(hamming64(hex_to_long(a), hex_to_long(b)))


def average_hash_bits(values: Column) -> Column:
    """'0'/'1' string: is each value above the mean of the array?"""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    bits = lambda v, m: F.transform(v, lambda x: F.when(x > m, F.lit("1")).otherwise(F.lit("0")))
    return F.array_join(let(values, lambda v: let(mean(v), lambda m: bits(v, m))), "")


def average_hash(values: Column) -> Column:
    """64-value array to a bigint hash."""
    return F.conv(average_hash_bits(values), 2, -10).cast("bigint")


def key_fingerprint(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Order-free fingerprint of the keys of each group, with the key count.

    First 12 hex digits of the sha1 of the count and of two sums, over the keys, of
    15 hex digits of each key's sha1. One form at every size, and the sums are
    combined before the shuffle.
    """
    h = F.sha1(F.col(key))
    piece = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")
    keyed = df.select(*by, piece(1).alias("_a"), piece(16).alias("_b"))
    totals = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"))
    return totals.select(*by, "n_keys", F.substring(F.sha1(F.concat_ws("|", "n_keys", "_sa", "_sb")), 1, 12).alias("fingerprint"))
