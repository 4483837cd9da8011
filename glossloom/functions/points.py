"""Expressions over frames: array<struct<x,y,z>> in storage order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions.bind import bound, let
from glossloom.functions.sequence import kalman_both, line_fill

LEFT, RIGHT, FACE = fixed.N_POSE, fixed.N_POSE + fixed.N_HAND, fixed.N_POSE + 2 * fixed.N_HAND


@bound
def from_face_first(frame: Column) -> Column:
    """(face, left, pose, right) order to storage order (pose, left, right, face)."""
    left, pose = fixed.N_FACE, fixed.N_FACE + fixed.N_HAND
    right = pose + fixed.N_POSE
    return F.concat(
        F.slice(frame, pose + 1, fixed.N_POSE), F.slice(frame, left + 1, fixed.N_HAND),
        F.slice(frame, right + 1, fixed.N_HAND), F.slice(frame, 1, fixed.N_FACE),
    )


@bound
def to_face_first(frame: Column) -> Column:
    return F.concat(
        F.slice(frame, FACE + 1, fixed.N_FACE), F.slice(frame, LEFT + 1, fixed.N_HAND),
        F.slice(frame, 1, fixed.N_POSE), F.slice(frame, RIGHT + 1, fixed.N_HAND),
    )


def reduced_rows() -> list[int]:
    return [*range(FACE), *[FACE + p for p in fixed.LIP_POINTS + fixed.NOSE_POINTS]]


def joint_rows() -> list[int]:
    hands = [base + p for base in (LEFT, RIGHT) for p in fixed.HAND_JOINTS]
    return [*fixed.POSE_JOINTS, *hands]


@bound
def pick(frame: Column, rows: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(r) for r in rows]), lambda i: F.get(frame, i))


def reduced(frame: Column) -> Column:
    """The 119 kept points."""
    return pick(frame, reduced_rows())


def joints(frame: Column) -> Column:
    """The 27 skeleton joints."""
    return pick(frame, joint_rows())


def pose_and_hands(frame: Column) -> Column:
    """The 75 points before the face."""
    return F.slice(frame, 1, FACE)


def flat(frame: Column) -> Column:
    return F.flatten(F.transform(frame, lambda p: F.array(p["x"], p["y"], p["z"])))


def xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def zero_missing(frame: Column) -> Column:
    """Missing coordinates (null or NaN) become 0."""
    fix = lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))
    return F.transform(frame, lambda p: xyz(fix(p["x"]), fix(p["y"]), fix(p["z"])))


def present(p: Column) -> Column:
    return (F.abs(p["x"]) + F.abs(p["y"]) + F.abs(p["z"])) > 0


#: Frames that one step over a batch works on at a time.
PIECE = 512


def piecewise(step, *columns: pa.Array) -> pa.Array:
    """step(*columns) piece by piece, so that a large batch needs little memory."""
    n = len(columns[0])
    return pa.concat_arrays([step(*[c.slice(at, PIECE) for c in columns]) for at in range(0, max(n, 1), PIECE)])


def unpacked(frames: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first point and number of points of each frame, values and validity (3, points)) of a batch of frames."""
    lengths = pc.fill_null(pc.list_value_length(frames), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = frames.flatten()  # points of null frames and those outside a slice are left out
    columns = flat.flatten()  # a missing point has missing coordinates
    values = np.stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in columns])
    return np.cumsum(lengths) - lengths, lengths, values, np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


def repacked(frames: pa.Array, values: np.ndarray, known: np.ndarray, filled: bool = False) -> pa.Array:
    """The batch with new values and validity of the coordinates; missing points stay missing unless all are filled."""
    gone = None if filled else frames.flatten().is_null()
    made = pa.StructArray.from_arrays([pa.array(x, mask=~k) for x, k in zip(values, known)], ["x", "y", "z"], mask=gone)
    lengths = pc.fill_null(pc.list_value_length(frames), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), made, mask=frames.is_null())


def _normalized(frames: pa.Array, fill: bool) -> pa.Array:
    """normalize_position of a batch; missing coordinates become 0 first or spread as in SQL."""
    starts, lengths, v, ok = unpacked(frames)
    if fill:
        v, ok = np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf), np.ones_like(ok)
    there = ok.all(axis=0) & ~(np.abs(v).sum(axis=0) <= 0)
    v, ok, there = (np.concatenate([a, np.zeros((*a.shape[:-1], 1), a.dtype)], axis=-1) for a in (v, ok, there))
    lh, rh, ls, rs = (np.where(i < lengths, starts + i, v.shape[1] - 1) for i in (23, 24, 11, 12))
    hips = there[lh] | there[rh]
    a, b = np.where(hips, lh, ls), np.where(hips, rh, rs)
    origin, origin_ok = (v[:, a] + v[:, b]) / 2, ok[:, a] & ok[:, b]
    width = np.hypot(*(v[:2, ls] - v[:2, rs]))
    scale, scale_ok = np.where(width < 1e-3, 1.0, width), (ok[:2, ls] & ok[:2, rs]).all(axis=0)
    of = np.repeat(np.arange(len(starts)), lengths)
    v, ok, there = v[:, :-1], ok[:, :-1], there[:-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        moved = np.where(there, (v - origin[:, of]) / np.where(scale_ok, scale, 1.0)[of], v)
    known = np.where(there, origin_ok[:, of] & scale_ok[of], ok)
    return repacked(frames, moved, known, fill)


def normalize_positions(frame: Column, fill: bool = False) -> Column:
    """normalize_position for a column of frames, after zero_missing with `fill`: a batch at once, which a lambda cannot use."""

    @F.arrow_udf("array<struct<x:double,y:double,z:double>>")
    def moved(frames: pa.Array) -> pa.Array:
        return piecewise(lambda f: _normalized(f, fill), frames)

    return moved(frame)


def _weighted(frames: pa.Array) -> pa.Array:
    starts, lengths, v, ok = unpacked(frames)
    of = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(of)) - starts[of] + 1.0
    sums = [np.bincount(of, np.where(k, x, 0.0) * place, len(starts)) for x, k in zip(v, ok)]
    return pa.StructArray.from_arrays([pa.array(s) for s in sums], ["x", "y", "z"], mask=frames.is_null())


def weighted_sums(frame: Column) -> Column:
    """Per coordinate, the sum of value times place (from 1) over a frame; missing values count 0."""
    return F.arrow_udf(lambda frames: piecewise(_weighted, frames), "struct<x:double,y:double,z:double>")(frame)


@bound
def normalize_position(frame: Column) -> Column:
    """Mid-hip (else mid-shoulder) to the origin, shoulder width to 1, present points only."""
    lh, rh, ls, rs = (F.get(frame, i) for i in (23, 24, 11, 12))
    mid = lambda a, b: xyz(*[(a[c] + b[c]) / 2 for c in "xyz"])
    origin = F.when(present(lh) | present(rh), mid(lh, rh)).otherwise(mid(ls, rs))
    width = F.hypot(ls["x"] - rs["x"], ls["y"] - rs["y"])
    scale = F.when(width < 1e-3, F.lit(1.0)).otherwise(width)

    def move(k: Column) -> Column:
        o, s = k["o"], k["s"]
        return F.transform(
            frame, lambda p: F.when(present(p), xyz(*[(p[c] - o[c]) / s for c in "xyz"])).otherwise(p)
        )

    return let(F.struct(origin.alias("o"), scale.alias("s")), move)


def smoothed(clips: pa.Array) -> pa.Array:
    """Occlusion fill and Kalman smoothing of a batch of clips, whose frames all have the same points.

    Coordinates that are null or not finite and points at the origin are missing and lie on the line
    between their neighbours in time; points missing in all frames become 0.
    """
    frames = clips.flatten()
    sizes = pc.fill_null(pc.list_value_length(clips), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    v, ok = (a.T.reshape(len(frames), -1, 3) if len(frames) else a.T for a in unpacked(frames)[2:])
    ok = ok & np.isfinite(v)
    ok &= (np.linalg.norm(np.where(ok, v, 0.0), axis=-1) >= 1e-6)[..., None]
    out = np.zeros(v.shape)
    for size in np.unique(sizes[sizes > 0]):
        at = starts[sizes == size][:, None] + np.arange(size)
        out[at] = kalman_both(line_fill(v[at], ok[at]).swapaxes(0, 1)).swapaxes(0, 1)
    made = out.reshape(-1, 3).T
    inner = repacked(frames, made, np.ones(made.shape, bool), True)
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), inner, mask=clips.is_null())


@bound
def center_joints(frames: Column) -> Column:
    """Root joint to the origin in every frame, mean shoulder width of the clip to 1.

    Clips without a usable shoulder width are scaled by twice their spread.
    """
    centred = lambda f, r: F.transform(f, lambda p: xyz(*[p[c] - r[c] for c in "xyz"]))
    move = lambda f: let(F.get(f, 0), lambda r: centred(f, r))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def scaled(x: Column) -> Column:
        d = lambda f, c: F.get(f, 1)[c] - F.get(f, 2)[c]
        widths = F.transform(x, lambda f: F.sqrt(d(f, "x") * d(f, "x") + d(f, "y") * d(f, "y") + d(f, "z") * d(f, "z")))
        width = total(widths) / F.size(widths)
        values = F.flatten(F.transform(x, flat))
        mean = total(values) / F.size(values)
        spread = F.sqrt(total(F.transform(values, lambda v: v * v)) / F.size(values) - mean * mean)
        scale = F.when(width.isNull() | F.isnan(width) | (width < 1e-4), spread * 2 + F.lit(1e-3)).otherwise(width)
        return let(scale, lambda s: F.transform(x, lambda f: F.transform(f, lambda p: xyz(*[p[c] / s for c in "xyz"]))))

    return let(F.transform(frames, move), scaled)


@bound
def hand_shape(hand: Column, mirror: bool = False) -> Column:
    """Wrist-relative points divided by the largest planar radius; missing points stay 0."""
    sign = F.lit(-1.0 if mirror else 1.0)
    turned = F.transform(hand, lambda p: xyz(p["x"] * sign, p["y"], p["z"]))

    def shape(h: Column) -> Column:
        w = F.get(h, 0)
        local = F.transform(
            h, lambda p: F.when(present(p), xyz(*[p[c] - w[c] for c in "xyz"])).otherwise(xyz(*[F.lit(0.0)] * 3))
        )

        def sized(lo: Column) -> Column:
            size = F.greatest(F.array_max(F.transform(lo, lambda p: F.hypot(p["x"], p["y"]))), F.lit(1e-3))
            return let(size, lambda s: F.transform(lo, lambda p: xyz(*[p[c] / s for c in "xyz"])))

        return let(local, sized)

    return let(turned, shape)


def hand_seen(hand: Column) -> Column:
    return F.exists(hand, present)


@bound
def face_relative(face: Column, nose: int = len(fixed.LIP_POINTS)) -> Column:
    """Face points relative to the nose; missing points stay 0."""
    n = F.get(face, nose)
    return F.transform(
        face, lambda p: F.when(present(p), xyz(*[p[c] - n[c] for c in "xyz"])).otherwise(xyz(*[F.lit(0.0)] * 3))
    )


def bone_pairs(root: int = 0, n: int = 27) -> list[tuple[int, int]]:
    """(parent, child) of every edge: the end nearer to the root is the parent, ties keep edge order."""
    edges = fixed.SKELETON_EDGES
    hops = {root: 0}
    for step in range(1, n):
        ring = {b if a in hops else a for a, b in edges if (a in hops) != (b in hops)}
        hops.update(dict.fromkeys(ring, step))
    return [(a, b) if hops[a] <= hops[b] else (b, a) for a, b in edges]


@bound
def bones(frame: Column, pairs: list[tuple[int, int]] | None = None) -> Column:
    """Child minus parent at every child joint (its last listed parent), 0 at the root."""
    pairs = bone_pairs() if pairs is None else pairs
    parent = {c: p for p, c in pairs}
    n = max(parent) + 1
    lookup = F.array(*[F.lit(parent.get(i, i)) for i in range(n)])
    return F.transform(frame, lambda p, i: xyz(*[p[c] - F.get(frame, F.get(lookup, i))[c] for c in "xyz"]))
