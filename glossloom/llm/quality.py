"""Quality by a sparse rule ensemble: tree paths over text statistics, lasso weights, rules as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import held_out, ship, text_or_empty
from glossloom.llm.fit import boosted_leaves, labelled_sample, lasso_logistic, sigmoid

#: Documents of each label that training may take.
ROWS = 3_000
TREES, DEPTH, RATE, LEAST, BINS = 40, 3, 0.2, 20, 32
#: Lasso penalties tried; the best on a fifth of the sample is used.
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)

STATISTICS = (
    "log_words", "word_length", "distinct_words", "distinct_lines", "largest_line", "lines_per_word", "words_per_line", "upper", "letters", "digits",
    "signs", "marks", "stops", "commas", "bars", "blanks", "high_bytes", "sign_words", "longest_word", "capital_words", "distinct_bytes", "top_byte", "repeated_pairs", "short_words",
)
_UPPER, _DIGITS, _SIGNS = bytes(range(65, 91)), bytes(range(48, 58)), b"#$%&*+<=>@^_`{}~\\/"
_LETTERS, _HIGH = _UPPER + bytes(range(97, 123)), bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS; zeros for a text without words."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(data)
    lines = [x for x in (y.strip() for y in data.split(b"\n")) if x]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda chars: float(counts[list(chars)].sum()) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    repeats: dict[bytes, int] = {}
    for line in lines:
        repeats[line] = repeats.get(line, 0) + 1
    return [
        math.log(n), float(lengths.mean()), len(set(words)) / n, len(repeats) / len(lines), max(k * len(x) for x, k in repeats.items()) / size,
        len(lines) / n, math.log1p(n / len(lines)), share(_UPPER), share(_LETTERS + _HIGH), share(_DIGITS),
        share(_SIGNS), share(b"!?"), share(b".;:"), share(b",'\"()-"), share(b"|"), share(b" \t"), share(_HIGH),
        sum(w[-1:] in b"#$%&*!|" for w in words) / n, math.log(float(lengths.max())), sum(w[:1].isupper() for w in words) / n,
        float((counts > 0).sum()) / min(size, 256), float(counts[33:].max()) / size, 1 - len(set(zip(words, words[1:]))) / max(1, n - 1), float((lengths <= 2).mean()),
    ]


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (statistic, '<=' or '>', value) with their weights, and an intercept."""

    rules: tuple[tuple[float, tuple[tuple[str, str, float], ...]], ...]
    intercept: float


def _tightest(path: list[tuple[int, str, float]]) -> tuple[tuple[int, str, float], ...]:
    """The path with one condition for each statistic and direction."""
    bounds: dict[tuple[int, str], float] = {}
    for j, sign, value in path:
        narrower = min if sign == "<=" else max
        bounds[j, sign] = narrower(value, bounds.get((j, sign), value))
    return tuple(sorted((j, sign, value) for (j, sign), value in bounds.items()))


def train(rows: list[tuple[str, int]], seed: int = 11) -> Rules:
    """Rules from the paths of boosted trees, weighted by lasso logistic regression; no rule where no tree can be split."""
    y = np.array([float(v) for _, v in rows])
    p = float(y.mean()) if len(y) else 0.5
    prior = Rules((), math.log((p + 0.01) / (1.01 - p)))
    if len(set(y)) < 2:
        return prior
    x = np.array([statistics(t) for t, _ in rows])
    # a small sample is split into smaller leaves
    least = max(2, min(LEAST, len(y) // 8))
    found = {_tightest(path) for paths in boosted_leaves(x, y, TREES, DEPTH, RATE, least, BINS, seed) for path in paths}
    if not found:
        return prior
    rules = sorted(found)
    fires = np.array([np.all([x[:, j] <= v if sign == "<=" else x[:, j] > v for j, sign, v in r], axis=0) for r in rules], dtype=float).T
    _, unique = np.unique(fires, axis=1, return_index=True)
    rules, fires = [rules[i] for i in sorted(unique)], fires[:, sorted(unique)]
    test = np.random.default_rng(seed).permutation(len(y)) % 5 == 0

    def loss(penalty: float) -> float:
        w, b = lasso_logistic(fires[~test], y[~test], penalty)
        p = np.clip(sigmoid(fires[test] @ w + b), 1e-6, 1 - 1e-6)
        return float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())

    w, b = lasso_logistic(fires, y, min(PENALTIES, key=loss))
    kept = [(float(v), tuple((STATISTICS[j], sign, c) for j, sign, c in r)) for v, r in zip(w, rules) if v]
    return Rules(tuple(kept), b)


def compiled(rules: Rules, stats: Column) -> Column:
    """The probability as one Spark expression over a struct of statistics."""
    total = F.lit(rules.intercept)
    for weight, conditions in rules.rules:
        fires = None
        for name, sign, value in conditions:
            one = stats[name] <= F.lit(value) if sign == "<=" else stats[name] > F.lit(value)
            fires = one if fires is None else fires & one
        total = total + F.when(fires, F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-total))


def text_statistics(texts: Column) -> Column:
    """Struct of the statistics of each whole text; null counts as empty."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(np.array([statistics(t or "") for t in batch]).reshape(len(batch), len(STATISTICS)), columns=list(STATISTICS))

    return measure(texts)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", modulo: int = 4, remainder: int = 2) -> Rules:
    return train(labelled_sample(docs, labels, label, ~held_out(doc_id, modulo, remainder), {0: ROWS, 1: ROWS}, text, doc_id))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every row.

    A null, empty or blank text has statistics of 0 and the score they give.
    Repeated rows get equal scores; a null id is not held out and never used for
    training. Only text is an input of a score; other columns are ignored. An empty
    table gives no rows; with labels of one kind every score is near that label.
    """
    ship(docs.sparkSession)
    rules = fit(docs, labels, text=text, doc_id=doc_id)
    measured = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, 4, 2).alias("held_out"), text_statistics(text_or_empty(text)).alias("_s"))
    scored = measured.select("doc_id", "held_out", compiled(rules, F.col("_s")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
