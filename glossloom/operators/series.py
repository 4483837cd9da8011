"""Time series: whole ones in blocks that carry their state on, and clips of bounded length.

No task holds a whole series: differences and windows see the neighbouring frames of
a block, running values start from summaries of the blocks before. Results do not
depend on the width of the blocks. Keys of series are not null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossloom import fixed
from glossloom.functions import points
from glossloom.functions.sequence import delay_modes, kalman_gains, kalman_map, kalman_run, same_length
from glossloom.operators.ranking import time_rank
from glossloom.session import checkpoint

#: Frames of a block; decides only how the work is spread.
BLOCK = 100_000


def cut_clips(df: DataFrame, by: list[str], ts: str, ties: list[str], frames: int = fixed.MAX_FRAMES) -> DataFrame:
    """Adds (clip, frame): each series is cut into clips of at most `frames` rows in time order.

    No row is dropped; the rank behind it splits hot series by time.
    """
    ranked = time_rank(df, by, ts, ties, "_pos")
    at = F.col("_pos") - 1
    return ranked.withColumn("clip", F.floor(at / frames)).withColumn("frame", F.pmod(at, F.lit(frames)).cast("int")).drop("_pos")


def clip_arrays(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row per clip with an array per column, in frame order (bounded by the clip length)."""
    packed = df.groupBy(*by, "clip").agg(F.array_sort(F.collect_list(F.struct("frame", *columns))).alias("_f"))
    field = lambda c: F.transform("_f", lambda e: e[c]).alias(c)
    return packed.select(*by, "clip", *[field(c) for c in columns])


def clip_window(by: list[str]) -> Window:
    return Window.partitionBy(*by, "clip").orderBy("frame")


def ordered(df: DataFrame, by: list[str], ts: str, ties: list[str]) -> DataFrame:
    """Adds frame: the place of a row in its whole series, from 0 in time order."""
    return time_rank(df, by, ts, ties, "_pos").withColumn("frame", F.col("_pos") - 1).drop("_pos")


def in_blocks(df: DataFrame, by: list[str], width: int = BLOCK, behind: int = 0, ahead: int = 0) -> DataFrame:
    """Adds _block, the frame range of a row, and copies to a block the frames just before and after it.

    A block sees `behind` frames before its first and `ahead` after its last one; on
    such lent rows _own is false. A series of any length is spread over its blocks.
    """
    at = lambda shift: F.floor((F.col("frame") + shift) / F.lit(width))
    if not (behind or ahead):
        return df.select("*", at(0).alias("_block"), F.lit(True).alias("_own"))
    reach = F.explode_outer(F.sequence(F.greatest(at(-ahead), F.lit(0)), at(behind)))
    return df.select("*", reach.alias("_block")).withColumn("_own", F.col("_block") == at(0))


def block_window(by: list[str]) -> Window:
    return Window.partitionBy(*by, "_block").orderBy("frame")


def own(rows: DataFrame) -> DataFrame:
    return rows.filter("_own").drop("_block", "_own")


def over_blocks(
    df: DataFrame, by: list[str], value: str, body: Callable[[Column], Column], behind: int, ahead: int, out: str, width: int = BLOCK
) -> DataFrame:
    """(by, frame, out): an array expression over whole series.

    body gets a block of values with its neighbours and gives as many values; what it
    gives for a frame may depend on `behind` frames before and `ahead` after it.
    """
    rows = in_blocks(df.select(*by, "frame", value), by, width, behind, ahead)
    packed = rows.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct("frame", value, "_own"))).alias("_f"))
    made = body(F.transform("_f", lambda e: e[value]))
    each = packed.select(*by, F.explode_outer(F.arrays_zip("_f", made.alias("_m"))).alias("_e"))
    return each.filter("_e._f._own").select(*by, F.col("_e._f.frame").alias("frame"), F.col("_e._m").alias(out))


def kinematics(df: DataFrame, by: list[str], value: str, width: int = BLOCK) -> DataFrame:
    """Adds velocity and acceleration; the first difference is repeated at the start."""
    w = block_window(by)
    diff = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c))
    return own(in_blocks(df, by, width, 2, 2).withColumn("vel", diff(value)).withColumn("acc", diff("vel")))


def masked_velocity(df: DataFrame, by: list[str], value: str, present: Column, width: int = BLOCK) -> DataFrame:
    """Adds velocity where this frame and the one before have the point, else 0."""
    w = block_window(by)
    rows = in_blocks(df.withColumn("_p", present), by, width, 1)
    both = F.col("_p") & F.coalesce(F.lag("_p").over(w), F.lit(False))
    return own(rows.withColumn("vel", F.when(both, F.col(value) - F.lag(value).over(w)).otherwise(F.lit(0.0))).drop("_p"))


def gap_fill(df: DataFrame, by: list[str], value: str, out: str = "filled", width: int = BLOCK) -> DataFrame:
    """Linear interpolation over missing frames; ends are held, all-missing series stay missing.

    Each block tells its first and last known frame; what lies before and after a
    block comes from these, so gaps are filled across any number of blocks.
    """
    rows = in_blocks(df, by, width).withColumn("_at", F.when(F.col(value).isNotNull(), F.struct("frame", value)))
    across = Window.partitionBy(*by).orderBy("_block")
    known = rows.groupBy(*by, "_block").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    known = known.select(
        *by, "_block", F.max("_last").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_first").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    back = block_window(by).rowsBetween(Window.unboundedPreceding, 0)
    ahead = block_window(by).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_l", F.last("_at", True).over(back)).withColumn("_r", F.first("_at", True).over(ahead)).join(known, [*by, "_block"])
    rows = rows.withColumn("_l", F.coalesce("_l", "_before")).withColumn("_r", F.coalesce("_r", "_after"))
    lt, lv, rt, rv = F.col("_l.frame"), F.col(f"_l.{value}"), F.col("_r.frame"), F.col(f"_r.{value}")
    line = lv + (rv - lv) * F.try_divide(F.col("frame") - lt, rt - lt)
    return own(rows.withColumn(out, F.coalesce(F.col(value), line, lv, rv))).select(*df.columns, out)


def rolling_mean(df: DataFrame, by: list[str], value: str, rows: int = 50, out: str = "rolling", width: int = BLOCK) -> DataFrame:
    w = block_window(by).rowsBetween(-(rows - 1), 0)
    return own(in_blocks(df, by, width, rows - 1).withColumn(out, F.avg(value).over(w)))


def best_epoch(df: DataFrame, by: list[str], score: str, patience: int, width: int = BLOCK) -> DataFrame:
    """Best frame of a history (last of ties) with early stopping, one row per history.

    The history ends at the first frame that is `patience` frames past the best so far.
    A block starts with the best of all blocks before it; the best so far at the stop
    is the answer, so one pass after the carried best is enough.
    """
    rows = in_blocks(df.select(*by, "frame", score), by, width).withColumn("_at", F.struct(score, "frame"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by, "_block").agg(F.max("_at").alias("_top")).select(*by, "_block", F.max("_top").over(before).alias("_before"))
    seen = block_window(by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.max("_at").over(seen)).join(tops, [*by, "_block"]).withColumn("_best", F.greatest("_run", "_before"))
    past = F.col("frame") - F.col("_best.frame") >= patience
    ends = rows.groupBy(*by).agg(F.min(F.when(past, F.struct("frame", "_best"))).alias("_stop"), F.max("_at").alias("_all"), F.max("frame").alias("_end"))
    best = F.coalesce("_stop._best", "_all")
    return ends.select(
        *by, best[score].alias("best_score"), best["frame"].alias("best_epoch"), F.coalesce("_stop.frame", "_end").alias("last_epoch"),
        F.col("_stop").isNotNull().alias("stopped_early"),
    )


def kalman_smooth(
    df: DataFrame, by: list[str], value: str, out: str = "smooth", q: float = fixed.KALMAN_Q, r: float = fixed.KALMAN_R, width: int = BLOCK
) -> DataFrame:
    """Mean of a forward filter over the gap-filled series and a backward filter over its output.

    The gains of the filter depend on the place alone, so a block maps the state before
    it to the state after it by a fixed matrix and a shift. Blocks give both, a series
    folds these few numbers (one row per block), then all blocks are filtered at once.
    All-missing series stay missing.
    """
    kept = list(df.columns)
    rows = in_blocks(gap_fill(df, by, value, "_v", width), by, width)
    packed = rows.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct("frame", "_v", *[c for c in kept if c not in (*by, "frame")]))).alias("_rows"))
    packed = checkpoint(packed.withColumn("_x", F.transform("_rows", lambda e: e["_v"])))
    state = "struct<n: bigint, z: double, p: double, v: double, m: array<double>>"

    def described(values: list[float], first: int) -> dict:
        """Length, first value, and how the filter moves a state over these values."""
        gains = kalman_gains(q, r)
        _, p, v = kalman_run(values, first, 0.0, 0.0, gains)
        return {"n": len(values), "z": values[0], "p": p, "v": v, "m": kalman_map(len(values), first, gains)}

    @F.pandas_udf(state)
    def ahead(values: pd.Series, block: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([described(x.tolist(), b * width) for x, b in zip(values, block)], columns=["n", "z", "p", "v", "m"])

    @F.pandas_udf(f"struct<f: array<double>, s: {state}>")
    def forward(values: pd.Series, block: pd.Series, p: pd.Series, v: pd.Series, total: pd.Series) -> pd.DataFrame:
        made = []
        for x, b, p0, v0, n in zip(values, block, p, v, total):
            run, _, _ = kalman_run(x.tolist(), b * width, p0, v0, kalman_gains(q, r))
            made.append({"f": run, "s": described(run[::-1], n - b * width - len(run))})
        return pd.DataFrame(made, columns=["f", "s"])

    @F.pandas_udf("array<double>")
    def backward(run: pd.Series, block: pd.Series, p: pd.Series, v: pd.Series, total: pd.Series) -> pd.Series:
        made = []
        for x, b, p0, v0, n in zip(run, block, p, v, total):
            back, _, _ = kalman_run(x[::-1].tolist(), n - b * width - len(x), p0, v0, kalman_gains(q, r))
            made.append((x + np.array(back)[::-1]) / 2)
        return pd.Series(made, dtype=object)

    @F.pandas_udf("array<struct<p: double, v: double>>")
    def folded(start: pd.Series, p: pd.Series, v: pd.Series, m: pd.Series) -> pd.Series:
        made = []
        for at, shift_p, shift_v, maps in zip(start, p, v, m):
            state, begin = (at, 0.0), []
            for dp, dv, (a, b, c, d) in zip(shift_p, shift_v, np.reshape(maps, (-1, 4))):
                begin.append({"p": state[0], "v": state[1]})
                state = a * state[0] + b * state[1] + dp, c * state[0] + d * state[1] + dv
            made.append(begin)
        return pd.Series(made, dtype=object)

    def entered(summaries: DataFrame, reverse: bool) -> DataFrame:
        """The state with which each block of a series begins, and the length of the series."""
        place = -F.col("_block") if reverse else F.col("_block")
        lists = summaries.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "_s"))).alias("_l"), F.sum("_s.n").alias("_total"))
        field = lambda name: F.transform("_l", lambda e: e["_s"][name])
        states = folded(F.get("_l", F.lit(0))["_s"]["z"], field("p"), field("v"), F.flatten(field("m")))
        each = lists.withColumn("_b", states).select(*by, "_total", F.explode_outer(F.arrays_zip("_l", "_b")).alias("_e"))
        return each.select(*by, "_total", F.abs("_e._l.at").alias("_block"), F.col("_e._b.p").alias("_p0"), F.col("_e._b.v").alias("_v0"))

    before = entered(packed.select(*by, "_block", ahead("_x", "_block").alias("_s")), False)
    run = packed.join(before, [*by, "_block"]).withColumn("_g", forward("_x", "_block", "_p0", "_v0", "_total"))
    run = checkpoint(run.select(*by, "_block", "_rows", F.col("_g.f").alias("_f"), F.col("_g.s").alias("_s")))
    after = entered(run.select(*by, "_block", "_s"), True)
    both = run.join(after, [*by, "_block"]).withColumn("_y", backward("_f", "_block", "_p0", "_v0", "_total"))
    each = both.select(*by, F.explode_outer(F.arrays_zip("_rows", "_y")).alias("_e"))
    known = F.when(F.col("_e._rows._v").isNotNull(), F.col("_e._y"))
    return each.select(*[F.col(c) if c in by else F.col(f"_e._rows.{c}").alias(c) for c in kept], known.alias(out))


def trim_clips(df: DataFrame, by: list[str], present: Column, min_keep: int = 4) -> DataFrame:
    """Drops leading and trailing frames without a hand, unless fewer than min_keep have one."""
    w = Window.partitionBy(*by, "clip")
    rows = df.withColumn("_p", present)
    rows = rows.select(
        "*", F.min(F.when(F.col("_p"), F.col("frame"))).over(w).alias("_a"), F.max(F.when(F.col("_p"), F.col("frame"))).over(w).alias("_z"),
        F.count_if("_p").over(w).alias("_n"),
    )
    keep = (F.col("_n") < min_keep) | F.col("frame").between(F.col("_a"), F.col("_z"))
    return rows.filter(keep).drop("_p", "_a", "_z", "_n")


def smooth_joints(df: DataFrame, clips: str) -> DataFrame:
    """The column of clips of points, filled and smoothed; a step of its own, as expressions that follow cannot hold a Python function."""

    def run(batches):
        for batch in batches:
            made = {n: points.piecewise(points.smoothed, c) if n == clips else c for n, c in zip(batch.schema.names, batch.columns)}
            yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    return df.mapInArrow(run, df.schema)


def dynamic_modes(
    df: DataFrame, keep: list[str], arr: Column, dim: int | Column = 1, delays: int = fixed.DMD_DELAYS, rank: int = fixed.DMD_MODES, coords: int = 1
) -> DataFrame:
    """Per clip: eigenvalues, amplitudes, mode magnitudes, spectrum and mode map of its dynamic modes.

    `dim` is the number of channels, one for all clips or a column; the mode map has
    one value per `coords` channels.
    """
    rows = df.select(*keep, arr.alias("_x"), (dim if isinstance(dim, Column) else F.lit(dim)).alias("_dim"))
    names = ["re", "im", "amp", "spatial", "spectrum", "modes"]
    fields = [f for f in rows.schema.fields if f.name not in ("_x", "_dim")]
    schema = T.StructType(fields + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])

    def run(batches):
        for pdf in batches:
            made = np.empty(len(pdf), object)
            for channels in pdf["_dim"].unique():
                some = np.flatnonzero(pdf["_dim"] == channels)
                for at, clips in same_length(pdf["_x"].iloc[some]):
                    made[some[at]] = delay_modes(clips.reshape(len(at), -1, channels), delays, rank, coords)
            yield pd.concat([pdf.drop(columns=["_x", "_dim"]), pd.DataFrame(list(made), columns=names)], axis=1)

    return rows.mapInPandas(run, schema)
