"""Small models fitted on bounded samples: labelled samples, logistic regression, lasso, shallow trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import text_or_empty


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, per_label: dict, text: str = "text", doc_id: str = "doc_id", max_bytes: int = 50_000
) -> list[tuple[str, object]]:
    """(text, label) of at most per_label[value] training documents for each value, chosen by a hash of the id.

    train is a condition on doc_id. Only texts up to max_bytes are taken, so the
    driver holds a bounded amount; null labels and ids are not used. The ids are
    chosen on narrow rows, then exactly those texts are fetched. Of conflicting
    labels of one id the greatest counts.
    """
    short = docs.filter(F.octet_length(text_or_empty(text)).between(1, max_bytes))
    known = labels.select(F.col(doc_id), F.col(label).alias("_y")).filter(F.col("_y").isNotNull() & F.col(doc_id).isNotNull())
    if labels is docs:
        known = short.select(F.col(doc_id), F.col(label).alias("_y")).filter(F.col("_y").isNotNull() & F.col(doc_id).isNotNull())
    else:
        known = known.join(short.select(doc_id), doc_id, "left_semi")
    known = known.filter(train).groupBy(doc_id).agg(F.max("_y").alias("_y"))
    order = [F.xxhash64(F.col(doc_id)), F.col(doc_id)]
    chosen = None
    for value, n in per_label.items():
        part = known.filter(F.col("_y") == F.lit(value)).orderBy(*order).limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return []
    rows = short.select(F.col(doc_id), text_or_empty(text).alias("_t")).join(F.broadcast(chosen), doc_id).select(F.col("_t"), F.col("_y"), order[0].alias("_h"), F.col(doc_id))
    out, left = [], dict(per_label)
    for r in sorted(rows.collect(), key=lambda r: (r["_h"], r[doc_id])):
        if left[r["_y"]] > 0:
            left[r["_y"]] -= 1
            out.append((r["_t"], r["_y"]))
    return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, intercept last, by Newton steps; the intercept is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Sparse weights and an unpenalised intercept by accelerated proximal gradient."""
    n, k = x.shape
    centre = x.mean(0)
    z = np.column_stack([x - centre, np.ones(n)])
    rate = 4 * n / max(np.linalg.norm(z.T @ z, 2), 1e-9)
    w = look = np.zeros(k + 1)
    momentum = 1.0
    for _ in range(steps):
        new = look - rate * (z.T @ (sigmoid(z @ look) - y)) / n
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty, 0)
        faster = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        look, w, momentum = new + (momentum - 1) / faster * (new - w), new, faster
    return w[:k], float(w[k] - centre @ w[:k])


def boosted_leaves(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, least: int, bins: int, seed: int) -> list[list[list[tuple[int, str, float]]]]:
    """Per tree, its paths (all nodes but the root) as lists of (feature, '<=' or '>', value).

    Each tree fits the gradient of the logistic loss on half of the rows.
    """
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    out = []
    for _ in range(trees):
        gradient = y - sigmoid(score)
        paths: list[list[tuple[int, str, float]]] = []

        def grow(rows: np.ndarray, scored: np.ndarray, path: list) -> None:
            if path:
                paths.append(path)
            g = gradient[rows]
            best = (1e-9, -1, -1)
            if len(path) < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    n = np.bincount(binned[rows, j], minlength=len(c) + 1).cumsum()[:-1]
                    s = np.bincount(binned[rows, j], weights=g, minlength=len(c) + 1).cumsum()[:-1]
                    ok = (n >= least) & (len(rows) - n >= least)
                    gain = np.where(ok, s**2 / np.maximum(n, 1) + (g.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - g.sum() ** 2 / len(rows), 0)
                    if gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
            if best[1] < 0:
                p = sigmoid(score[rows])
                score[scored] += rate * np.clip(g.sum() / max((p * (1 - p)).sum(), 1e-3), -4, 4)
                return
            _, j, k = best
            value = float(cuts[j][k])
            for sign, keep in (("<=", lambda r: binned[r, j] <= k), (">", lambda r: binned[r, j] > k)):
                grow(rows[keep(rows)], scored[keep(scored)], [*path, (j, sign, value)])

        half = rng.permutation(len(y))[: max(2, len(y) // 2)]
        grow(half, np.arange(len(y)), [])
        out.append(paths)
    return out
