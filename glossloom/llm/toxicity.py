"""Toxicity by compression distance: windows compressed with a dictionary of toxic and one of ordinary text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import broadcast, held_out, text_or_empty
from glossloom.llm.fit import labelled_sample, logistic, sigmoid

#: Documents of each label that training may take; a third of them calibrates.
TOXIC_ROWS, ORDINARY_ROWS = 3_200, 9_600
#: Bytes of a window and between windows: a word of sixteen bytes is whole in one of them.
WINDOW, STRIDE = 32, 16
#: Bytes of the common background and of the part that differs.
BACKGROUND, OWN = 65_536, 6_144
LEVEL = 3
#: Word forms belong to the toxic text if they are in at least so many of its documents and so many times likelier there.
LEAST_DOCS, LEAST_LIFT = 8, 8.0
#: Bytes saved in a window that count as steps.
STEPS = (2, 3, 4, 5, 6, 7, 8, 10)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _compress(content: bytes):
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def windows(text: str) -> list[bytes]:
    data = text.lower().encode()
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STRIDE)), STRIDE)]


def _features(text: str, ordinary, toxic) -> list[float]:
    """Shares of windows that the toxic dictionary shortens by so many bytes more, and the largest savings."""
    saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])
    n = len(saved)
    shares = [np.log1p(100.0 * (saved >= k).sum() / (n + 5)) for k in STEPS]
    top = np.sort(saved)[::-1][:3].clip(0)
    return [*shares, float(top[0]), float(top.mean()), float(np.log(n))]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; too little text for training is taken as it is."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train(rows: list[tuple[str, int]], seed: int = 5) -> Model:
    """Fits both dictionaries on two thirds of the rows and the calibration on the rest.

    Both dictionaries hold the same background, trained on ordinary windows; then
    each has its own part, trained on ordinary windows and on the words that set
    toxic documents apart. So lengths differ only where a window resembles one
    part and not the other.
    """
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(rows))
    first, second = [rows[i] for i in part[: 2 * len(rows) // 3]], [rows[i] for i in part[2 * len(rows) // 3 :]]
    split = {y: [t for t, v in first if int(v) == y] for y in (0, 1)}
    rate = {y: 1.0 / (len(ts) + 1) for y, ts in split.items()}
    often = {w: n for w, n in Counter(w for t in split[1] for w in set(t.lower().encode().split())).items() if n >= LEAST_DOCS}
    plain = Counter(w for t in split[0] for w in set(t.lower().encode().split()) if w in often)
    apart = {w for w, n in often.items() if (n + 0.5) * rate[1] >= LEAST_LIFT * (plain[w] + 0.5) * rate[0]}
    found = [b" " + w + b" " for t in split[1] for w in t.lower().encode().split() if w in apart]
    common = [w for t in split[0][:2_000] for w in windows(t)]
    common = [common[i] for i in rng.permutation(len(common))[:90_000]]
    found = [found[i] for i in rng.permutation(len(found))]
    background = _dictionary(common[:60_000], BACKGROUND)
    ordinary = background + _dictionary(common[60_000:], OWN)
    toxic = background + _dictionary([b"".join(found[i : i + 8]) for i in range(0, len(found), 8)], OWN)
    c, d = _compress(ordinary), _compress(toxic)
    x, y = np.array([_features(t, c, d) for t, _ in second]).reshape(len(second), len(STEPS) + 3), np.array([float(v) for _, v in second])
    weights = logistic(x, y, 0.5) if len(second) else np.zeros(len(STEPS) + 4)
    return Model(ordinary, toxic, tuple(weights))


def toxicity(texts: Column, model: Model, spark) -> Column:
    """Score of each whole text; null counts as empty."""
    shared = broadcast(spark, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        c, d, w = _compress(m.ordinary), _compress(m.toxic), np.array(m.weights)
        for batch in batches:
            x = np.array([_features(t or "", c, d) for t in batch]).reshape(len(batch), len(w) - 1)
            yield pd.Series(sigmoid(x @ w[:-1] + w[-1]))

    return score(texts)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", modulo: int = 5, remainder: int = 0) -> Model:
    rows = labelled_sample(docs, labels, label, ~held_out(doc_id, modulo, remainder), {1: TOXIC_ROWS, 0: ORDINARY_ROWS}, text, doc_id)
    return train(rows)


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts have no windows to speak of and get the score of an empty
    one. Repeated rows get equal scores; a null id is not held out and never used
    for training. Only text is an input of a score; other columns are ignored. An
    empty table gives no rows; without labels of both kinds the scores say little
    but are defined.
    """
    model = fit(docs, labels, text=text, doc_id=doc_id)
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, 5, 0).alias("held_out"), toxicity(text_or_empty(text), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
