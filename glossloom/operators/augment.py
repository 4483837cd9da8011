"""Augmentation as table expansion: every clip becomes n copies with seeded parameters."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.bind import bound
from glossloom.functions.hashing import seeded_order, unit_interval
from glossloom.functions.points import piecewise, repacked, unpacked


def copies(df: DataFrame, n: int, out: str = "copy") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def uniform(low: float, high: float, *salt) -> Column:
    """Seeded value in [low, high), equal on every engine that has md5."""
    return F.lit(low) + F.lit(high - low) * unit_interval(seeded_order(*salt))


def gaussian(*salt) -> Column:
    """Seeded standard normal value (Box-Muller)."""
    u1 = F.greatest(unit_interval(seeded_order(*salt, "u1")), F.lit(1e-12))
    u2 = unit_interval(seeded_order(*salt, "u2"))
    return F.sqrt(-2 * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


@bound
def time_warp(arr: Column, speed: Column, shift: Column) -> Column:
    """Speed change around the middle and a shift in frames; ends are held (not circular)."""
    n = F.size(arr)
    mid = (n - 1) / 2
    src = lambda i: F.bround((i - mid) * speed + mid + shift)
    at = lambda i: F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), src(i))).cast("int")
    return F.when(n < 2, arr).otherwise(F.transform(arr, lambda _x, i: F.get(arr, at(i))))


def warp_params(n: Column, *salt, max_speed: float = 0.2, max_shift: float = 0.15) -> tuple[Column, Column]:
    return (
        uniform(1 - max_speed, 1 + max_speed, *salt, "speed"),
        uniform(-max_shift, max_shift, *salt, "shift") * n,
    )


def augment_points(
    frame: Column, *salt, frame_no: Column | None = None, rot_deg=15.0, scale=0.15, shift=0.1, noise=0.01
) -> Column:
    """Rotation, scale, small anisotropy, shift and noise on present points; missing stay 0.

    The salt names the copy: all its frames share one parameter set; frame_no only
    varies the noise. Frames are moved a batch at once; `frame` is a column, not an
    expression with lambdas.
    """
    p = lambda name, lim: uniform(-lim, lim, *salt, name)
    k = F.struct(
        p("angle", math.radians(rot_deg)).alias("t"), (1 + p("scale", scale)).alias("s"), (1 + p("ax", 0.08)).alias("ax"),
        (1 + p("ay", 0.08)).alias("ay"), p("sx", shift).alias("sx"), p("sy", shift).alias("sy"),
    )
    spot = frame_no if frame_no is not None else F.lit(0)
    text = F.concat_ws("|", *[c.cast("string") if isinstance(c, Column) else F.lit(str(c)) for c in (*salt, spot)])

    @F.arrow_udf("array<struct<x:double,y:double,z:double>>")
    def moved(frames: pa.Array, params: pa.Array, texts: pa.Array) -> pa.Array:
        return piecewise(lambda f, p, t: _moved(f, p, t.to_pylist(), noise), frames, params, texts)

    return moved(frame, k, text)


def _moved(frames: pa.Array, params: pa.Array, texts: list[str], noise: float) -> pa.Array:
    """augment_points of a batch; the noise of a value is gaussian(text, point, axis), md5 by md5."""
    starts, lengths, v, ok = unpacked(frames)
    there = ok.all(axis=0) & ~(np.abs(v).sum(axis=0) <= 0)
    of = np.repeat(np.arange(len(starts)), lengths)
    t, s, ax, ay, sx, sy = (params.field(i).to_numpy(zero_copy_only=False)[of[there]] for i in range(6))
    x, y, z = v[:, there]
    made = np.stack([(x * np.cos(t) - y * np.sin(t)) * s * ax + sx, (x * np.sin(t) + y * np.cos(t)) * s * ay + sy, z * s])
    if noise:
        places = np.flatnonzero(there) - starts[of[there]]
        ends = [[f"|{i}|{axis}|{u}".encode() for axis in "xyz" for u in ("u1", "u2")] for i in range(lengths.max(initial=0))]
        parts, cuts = [], np.searchsorted(of[there], np.arange(len(starts) + 1))
        for row, (a, b) in enumerate(zip(cuts, cuts[1:])):
            head = texts[row].encode()
            parts += [md5(head + end).digest() for i in places[a:b] for end in ends[i]]
        first = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 3, 2, 16)[..., :6].astype(np.float64)
        u = first @ 256.0 ** -np.arange(1, 7)
        made += noise * (np.sqrt(-2 * np.log(np.maximum(u[..., 0], 1e-12))) * np.cos(2 * np.pi * u[..., 1])).T
    v[:, there] = made
    return repacked(frames, v, ok)


def coordinate_noise(arr: Column, std: float, *salt) -> Column:
    """Additive noise on non-zero values."""
    return F.transform(arr, lambda x, i: F.when(x != 0, x + F.lit(std) * gaussian(*salt, i)).otherwise(x))


def feature_noise(arr: Column, std: float, *salt) -> Column:
    """Multiplicative noise."""
    return F.transform(arr, lambda x, i: x * (1 + F.lit(std) * gaussian(*salt, i)))
