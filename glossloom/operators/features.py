"""Feature table: one row per clip and modality, from a registry of named feature functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions import sequence

Feature = Callable[[Column], Column]


def user_transform(fn: Callable[[np.ndarray], np.ndarray]) -> Feature:
    """A numpy function on one clip's values as a feature function; runs in Arrow batches, null clips stay null."""

    @F.pandas_udf("array<double>")
    def apply(clips: pd.Series) -> pd.Series:
        return clips.map(lambda x: None if x is None else np.asarray(fn(np.asarray(x, float)), float))

    return lambda values: apply(values)


class Modalities:
    """Named feature functions: value array of a clip -> feature array."""

    def __init__(self, **known: Feature):
        self._known = dict(known)

    def register(self, name: str, feature: Feature) -> None:
        if name in self._known:
            raise ValueError(f"modality {name!r} is taken")
        self._known[name] = feature

    def names(self) -> list[str]:
        return sorted(self._known)

    def feature(self, name: str, values: Column) -> Column:
        if name not in self._known:
            raise ValueError(f"unknown modality {name!r}, known: {', '.join(self.names())}")
        return self._known[name](values)


def standard() -> Modalities:
    """Values as they are, resampled to the model's length, and their motion energy."""
    return Modalities(value=lambda v: v, resampled=lambda v: sequence.resample(v), energy=lambda v: F.array(sequence.kinetic_energy(v)))


def feature_table(clips: DataFrame, keys: list[str], values: str, modalities: Modalities, names: Iterable[str] | None = None) -> DataFrame:
    """keys, modality, n and features; one row for each clip and modality.

    Every clip is read once: the modalities are computed side by side and turned
    into rows. Write it partitioned by modality and later runs read only what they
    need, by key.
    """
    parts = [F.struct(F.lit(m).alias("modality"), modalities.feature(m, F.col(values)).cast("array<double>").alias("features")) for m in (names or modalities.names())]
    rows = clips.select(*keys, F.explode(F.array(*parts)).alias("_f"))
    return rows.select(*keys, "_f.modality", F.size("_f.features").cast("bigint").alias("n"), "_f.features")


def score_table(table: DataFrame, keys: list[str], model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys, modality and score: a frozen model, numpy array of equally long rows -> one number a row, over the table in batches."""

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        out = np.full(len(features), np.nan)
        for at, rows in sequence.same_length(features):
            out[at] = model(rows)
        return pd.Series(out)

    return table.select(*keys, "modality", score("features").alias("score"))
