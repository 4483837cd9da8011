"""Closed-form and resampling statistics on pre-aggregated counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96, clamp: bool = False) -> Column:
    """Wilson interval struct<p, low, high>.

    clamp=False: null at n = 0. clamp=True: limited to [0, 1], zeros at n = 0.
    """
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    z2 = F.lit(z * z)
    den = 1 + F.try_divide(z2, n)
    center = (p + F.try_divide(z2, 2 * n)) / den
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(z2, 4 * n * n)) / den
    low, high = center - half, center + half
    if clamp:
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        low, high = F.greatest(F.lit(0.0), zero(low)), F.least(F.lit(1.0), zero(high))
        p = zero(p)
    return F.struct(p.alias("p"), low.alias("low"), high.alias("high"))


def _log_gamma(z: Column) -> Column:
    """Stirling series after a shift by 8."""
    shifted = F.lit(1.0)
    for i in range(8):
        shifted = shifted * (z + i)
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3.0)) + 1 / (1260 * F.pow(y, 5.0))
    return (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(shifted)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p-value from the discordant counts.

    Twice the lower binomial tail at 1/2. Its terms shrink from the largest one,
    which comes from log-gamma; those further than ten standard deviations down are
    below the rounding of a double and are not summed.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    pair = lambda t, s: F.struct(t.alias("t"), s.alias("s"))
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) - n * F.lit(math.log(2)))
    steps = F.least(k, F.sqrt(n) * 5 + 50).cast("bigint")
    downward = F.when(steps > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(steps, F.lit(1).cast("bigint")))).otherwise(F.array().cast("array<bigint>"))
    smaller = lambda a, i: a["t"] * (k - i + 1) / (n - k + i)
    tail = F.aggregate(downward, pair(top, top), lambda a, i: pair(smaller(a, i), a["s"] + smaller(a, i)), lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar_winner(a_better: Column, b_better: Column) -> Column:
    return F.when(a_better == b_better, "tie").when(a_better > b_better, "A").otherwise("B")


def _seed(*parts) -> np.random.Generator:
    return np.random.default_rng([int(p) for p in parts])


def paired_bootstrap(b: Column, c: Column, n: Column, n_boot: int = 2000, seed: int = 0) -> Column:
    """struct<delta, low, high>: accuracy difference (c - b) / n with a 95 % interval.

    The per-item difference is -1, 0 or 1, so a resample of n items is one
    multinomial draw of the three counts, whatever n is.
    """

    @F.pandas_udf("delta double, low double, high double")
    def boot(b: pd.Series, c: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for nb, nc, nn in zip(b, c, n):
            if nn == 0:
                rows.append((None, None, None))
                continue
            draw = _seed(seed, nb, nc, nn).multinomial(nn, [nb / nn, nc / nn, (nn - nb - nc) / nn], n_boot)
            diff = (draw[:, 1] - draw[:, 0]) / nn
            rows.append(((nc - nb) / nn, *np.quantile(diff, [0.025, 0.975])))
        return pd.DataFrame(rows, columns=["delta", "low", "high"])

    return boot(b, c, n)


def _macro_acc(y: np.ndarray, ok: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean over the drawn classes of their accuracy, for every resample (rows of weight)."""
    classes = np.unique(y)
    total = np.stack([weight[:, y == k].sum(1) for k in classes], 1).astype(float)
    right = np.stack([weight[:, (y == k) & ok].sum(1) for k in classes], 1).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nanmean(np.where(total > 0, right / total, np.nan), 1)


def _macro_f1(y: np.ndarray, pred: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean F1 over the classes drawn as label or prediction, for every resample."""
    scores = []
    for k in np.unique(np.concatenate([y, pred])):
        seen = weight[:, y == k].sum(1) + weight[:, pred == k].sum(1)
        hit = weight[:, (y == k) & (pred == k)].sum(1)
        scores.append(np.where(seen > 0, 2 * hit / np.maximum(seen, 1), np.nan))
    return np.nanmean(np.stack(scores, 1), 1)


def bootstrap_cells(cells: list, fn, n_boot: int, seed: int) -> tuple[float, float, float]:
    """Point and 95 % interval of fn over resamples of a confusion table."""
    y = np.array([c["y"] for c in cells])
    pred = np.array([c["pred"] for c in cells])
    n = np.array([c["n"] for c in cells], dtype=np.int64)
    weights = np.concatenate([n[None, :], _seed(seed, n.sum()).multinomial(n.sum(), n / n.sum(), n_boot)])
    stat = fn(y, pred, weights)
    return float(stat[0]), *map(float, np.quantile(stat[1:], [0.025, 0.975]))


MACRO_METRICS = {
    "macro_acc": lambda y, pred, w: _macro_acc(y, y == pred, w),
    "macro_f1": _macro_f1,
}


def bootstrap_metric(cells: Column, fn, n_boot: int = 2000, seed: int = 0) -> Column:
    """struct<point, low, high> of a metric of (y, pred, weights).

    `cells` is array<struct<y,pred,n>>: at most classes squared entries, so the
    cost of a resample does not depend on the number of predictions. `fn` is a name
    from MACRO_METRICS or any function of the same form.
    """
    use = MACRO_METRICS[fn] if isinstance(fn, str) else fn

    @F.pandas_udf("point double, low double, high double")
    def boot(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bootstrap_cells(list(c), use, n_boot, seed) for c in s], columns=["point", "low", "high"])

    return boot(cells)


def bootstrap_macro_delta(cells: Column, n_boot: int = 2000, seed: int = 0) -> Column:
    """struct<delta, low, high>: macro accuracy of A minus that of B on shared resamples.

    `cells` is array<struct<y,a_ok,b_ok,n>>.
    """

    @F.pandas_udf("delta double, low double, high double")
    def boot(s: pd.Series) -> pd.DataFrame:
        rows = []
        for cs in s:
            y = np.array([c["y"] for c in cs])
            a, b = (np.array([c[k] for c in cs], dtype=bool) for k in ("a_ok", "b_ok"))
            n = np.array([c["n"] for c in cs], dtype=np.int64)
            w = np.concatenate([n[None, :], _seed(seed, n.sum()).multinomial(n.sum(), n / n.sum(), n_boot)])
            d = _macro_acc(y, a, w) - _macro_acc(y, b, w)
            rows.append((d[0], *np.quantile(d[1:], [0.025, 0.975])))
        return pd.DataFrame(rows, columns=["delta", "low", "high"])

    return boot(cells)
