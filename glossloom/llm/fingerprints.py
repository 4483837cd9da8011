"""Consistent weighted sampling of weighted terms: signatures that collide with the generalised Jaccard similarity.

Built-in functions only. A term is a word, its weight the number of its
occurrences. For each position of the signature, a term S of weight w gets
r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of the term, then
t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp r); the sample is
the term and t with the least a. As a is a function of position, term and t, the
least a itself stands for the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import discard, stored, text_or_empty
from glossloom.operators.ranking import range_rank

SAMPLES = 32
_UNIFORM = float(1 << 31)


def _least(k: int, log_weight: Column) -> Column:
    """ln a at position k for the term hashed in _h; null (no sample) for a null weight."""
    one, two, three = (F.xxhash64(F.col("_h"), F.lit(3 * k + i)) for i in range(3))
    high = lambda x: (F.shiftrightunsigned(x, 33).cast("double") + 0.5) / F.lit(_UNIFORM)
    low = lambda x: (x.bitwiseAND(F.lit((1 << 31) - 1)).cast("double") + 0.5) / F.lit(_UNIFORM)
    r = -F.log(high(one) * low(one))
    log_c = F.log(-F.log(high(two) * low(two)))
    b = high(three)
    t = F.floor(log_weight / r + b).cast("double")
    return log_c - r * (t - b) - r


def weighted_terms(texts: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, _h and the number of occurrences of each term in each of the text columns (_n0, _n1, ...).

    One more term, of no text, stands for every row, so that rows without words are not lost.
    """

    def tagged_words(i: int, c: str) -> Column:
        return F.transform(F.split(F.col(c), "[\\x20\\x09-\\x0D]+"), lambda w: F.struct(F.lit(i).alias("c"), F.xxhash64(w).alias("h"), (w != "").alias("ok")))

    none = F.array(F.struct(F.lit(-1).alias("c"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("ok")))
    tagged = F.flatten(F.array(none, *[tagged_words(i, c) for i, c in enumerate(columns)]))
    rows = texts.select(*by, F.inline(tagged)).filter("ok")
    return rows.groupBy(*by, F.col("h").alias("_h")).agg(*[F.count_if(F.col("c") == i).alias(f"_n{i}") for i in range(len(columns))])


def fingerprints(texts: DataFrame, by: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """by and a fingerprint for each text column (_f0, _f1, ...), eight hex digits a position.

    Rows of one key must be one row; texts without a term have the empty fingerprint.
    Where texts already lie partitioned by their key, nothing is shuffled.
    """
    terms = weighted_terms(texts, by, columns)
    # the logarithm of 0 is null: a term that a text lacks gives it no sample
    logs = terms.select(*by, "_h", *[F.log(F.col(f"_n{i}").cast("double")).alias(f"_l{i}") for i in range(len(columns))])
    least = logs.groupBy(*by).agg(*[F.min(_least(k, F.col(f"_l{i}"))).alias(f"_m{i}_{k}") for k in range(samples) for i in range(len(columns))])
    digits = lambda c: F.lpad(F.lower(F.hex(F.xxhash64(F.col(c)).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return least.select(*by, *[F.when(F.col(f"_m{i}_0").isNull(), F.lit("")).otherwise(F.concat(*[digits(f"_m{i}_{k}") for k in range(samples)])).alias(f"_f{i}") for i in range(len(columns))])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal positions; texts without terms are like each other and like no other text."""
    same = sum((F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / F.lit(float(samples)))


def neighbours(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, bool]:
    """(texts by _k, one narrow row per distinct document with its neighbours, whether rows repeat).

    The order is by falling id, null last, then by _k; the last is followed by the first.
    """
    t = text_or_empty(text)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t"), F.xxhash64(F.col(doc_id), F.length(t), t).alias("_k"))
    nodes = keyed.groupBy("_k", "doc_id", F.length("_t").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("_times"))
    ranked = stored(range_rank(nodes, [], [F.col("doc_id").desc_nulls_last(), F.col("_k")], "_pos", "_total"), "order")
    after = ranked.select(F.col("_pos").alias("_p"), F.col("_k").alias("_next"))
    before = ranked.select((F.col("_pos") % F.col("_total") + 1).alias("_pos"), F.col("_k").alias("_before"), F.floor(F.col("n_chars") / 2).cast("int").alias("_head"))
    linked = ranked.join(after, F.col("_p") == F.col("_pos") % F.col("_total") + 1).join(before, "_pos")
    links = stored(linked.select("_k", "doc_id", "n_chars", "_times", "_next", "_before", "_head"), "neighbours")
    discard(ranked)
    return keyed.select("_k", "_t"), links, links.filter("_times > 1").limit(1).count() > 0


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has the last floor(n_chars / 2) code points replaced by as many
    (or all) from the start of the next document. Null texts count as empty; texts
    without words have the empty fingerprint, like only that of other such texts.
    Rows with equal id and text are one document in the order and get equal rows;
    null ids come last, and equal ids with different texts are ordered by a hash.
    Other columns are ignored. An empty table gives no rows.

    A text is shuffled once, half of it a second time to the document before it;
    hash and fingerprints are taken in the same pass over both.
    """
    texts, links, repeats = neighbours(docs, text, doc_id)
    if repeats:
        texts = texts.dropDuplicates(["_k"])
    own = texts.join(links.select("_k", "n_chars"), "_k")
    heads = texts.join(links.select("_k", "_before", "_head"), "_k").select(F.col("_before").alias("_k"), F.left(F.col("_t"), F.col("_head")).alias("_h"))
    kept = F.left(F.col("_t"), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    both = own.join(heads, "_k").select("_k", "_t", F.concat(kept, F.col("_h")).alias("_e"))
    hashed = both.select("_k", "_t", "_e", F.unhex(F.sha2(F.col("_e").cast("binary"), 256)).alias("_sha"))
    prints = stored(fingerprints(hashed, ["_k", "_sha"], ["_t", "_e"], samples), "fingerprints")
    following = prints.select(F.col("_k").alias("_next"), F.col("_f0").alias("_f"))
    full = links.join(prints, "_k").join(following, "_next")
    f, e, n = F.col("_f0"), F.col("_f1"), F.col("_f")
    rows = full.select("doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), f.alias("fingerprint"), e.alias("edited_fingerprint"), likeness(f, e, samples).alias("near_edited"), likeness(f, n, samples).alias("near_next"), "_times")
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("_i", "_times") if repeats else rows.drop("_times")
