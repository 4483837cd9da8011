"""Queries on trajectories, frames of points and augmentation.

Computed arrays are exploded with the outer form: the inner form makes the optimizer
add a filter that computes the array a second time, below every exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions import points, sequence
from glossloom.operators import augment, features, reports, series
from glossloom.operators.guarded import guarded
from glossloom.plans import views
from glossloom.plans.registry import query
from glossloom.plans.views import with_views
from glossloom.sources import landmarks

USER = ["user_id"]
CLIP = ["user_id", "clip"]


def _arrays(spark, d, *cols):
    return series.clip_arrays(views.frames(spark, d), USER, list(cols or ("value",)))


_WHOLE = ", arr AS (SELECT user_id, list(value ORDER BY frame) AS v, count(*) AS n FROM series GROUP BY ALL)"
_ARR = ", arr AS (SELECT user_id, clip, list(value ORDER BY frame) AS v, list(k ORDER BY frame) AS ks, count(*) AS n FROM frames GROUP BY ALL)"


def _long(df, arr, name="x"):
    """One row per array element with its position; values rounded."""
    rows = df.select(*CLIP, F.posexplode_outer(arr).alias("i", name)).filter(F.col("i").isNotNull())
    return rows.withColumn(name, F.round(name, 6))


@query("kinematics", with_views("series", body="""
    , v AS (SELECT *, coalesce(value - lag(value) OVER w, lead(value) OVER w - value) AS vel FROM series WINDOW w AS (PARTITION BY user_id ORDER BY frame))
    SELECT event_id, frame, round(vel, 6) AS vel, round(coalesce(vel - lag(vel) OVER w, lead(vel) OVER w - vel), 6) AS acc
    FROM v WINDOW w AS (PARTITION BY user_id ORDER BY frame)"""))
def kinematics(spark, d):
    rows = series.kinematics(views.series_rows(spark, d), USER, "value")
    return rows.select("event_id", "frame", F.round("vel", 6).alias("vel"), F.round("acc", 6).alias("acc"))


@query("finite_diff_arrays", with_views("series", body=_WHOLE + """
    SELECT user_id, i - 1 AS frame, round(v[greatest(i, 2)] - v[greatest(i, 2) - 1], 6) AS x FROM (
      SELECT *, unnest(range(1, n + 1)) AS i FROM arr WHERE n >= 2)"""))
def finite_diff_arrays(spark, d):
    rows = series.over_blocks(views.series_rows(spark, d), USER, "value", sequence.finite_diff, 1, 1, "x")
    return rows.filter(F.col("x").isNotNull()).withColumn("x", F.round("x", 6))


@query("masked_velocity", with_views("series", body="""
    SELECT event_id, round(CASE WHEN k > 25 AND coalesce(lag(k > 25) OVER w, false) THEN value - lag(value) OVER w ELSE 0 END, 6) AS vel
    FROM series WINDOW w AS (PARTITION BY user_id ORDER BY frame)"""))
def masked_velocity(spark, d):
    rows = series.masked_velocity(views.series_rows(spark, d), USER, "value", F.col("k") > 25)
    return rows.select("event_id", F.round("vel", 6).alias("vel"))


@query("resample_30", with_views("frames", body=_ARR + """
    SELECT user_id, clip, CAST(i AS INTEGER) AS i, round(v[1 + CASE WHEN n >= 30 THEN (i * (n - 1)) // 29 ELSE least(i, n - 1) END], 6) AS x
    FROM (SELECT *, unnest(range(30)) AS i FROM arr)"""))
def resample_30(spark, d):
    return _long(_arrays(spark, d), sequence.resample(F.col("value")))


@query("trim_ends", with_views("frames", body="""
    , b AS (SELECT *, min(frame) FILTER (k > 60) OVER w AS a, max(frame) FILTER (k > 60) OVER w AS z, count(*) FILTER (k > 60) OVER w AS c
      FROM frames WINDOW w AS (PARTITION BY user_id, clip))
    SELECT event_id, clip, frame FROM b WHERE c < 4 OR frame BETWEEN a AND z"""))
def trim_ends(spark, d):
    rows = series.trim_clips(views.frames(spark, d), USER, F.col("k") > 60)
    return rows.select("event_id", "clip", "frame")


@query("trim_arrays", with_views("frames", body="""
    , b AS (SELECT *, min(frame) FILTER (k > 60) OVER w AS a, max(frame) FILTER (k > 60) OVER w AS z, count(*) FILTER (k > 60) OVER w AS c
      FROM frames WINDOW w AS (PARTITION BY user_id, clip))
    SELECT user_id, clip, CAST(row_number() OVER (PARTITION BY user_id, clip ORDER BY frame) - 1 AS INTEGER) AS i, round(value, 6) AS x
    FROM b WHERE c < 4 OR frame BETWEEN a AND z"""))
def trim_arrays(spark, d):
    rows = _arrays(spark, d, "value", "k")
    return _long(rows, sequence.trim_ends(F.col("value"), F.transform("k", lambda k: k > 60)))


_FILLED = """
    , g AS (SELECT *, CASE WHEN k < 70 THEN value END AS gv, CASE WHEN k < 70 THEN frame END AS gf FROM series),
    s AS (SELECT *, last_value(gv IGNORE NULLS) OVER a AS lv, last_value(gf IGNORE NULLS) OVER a AS lf,
      first_value(gv IGNORE NULLS) OVER z AS rv, first_value(gf IGNORE NULLS) OVER z AS rf FROM g
      WINDOW a AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             z AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT *, coalesce(gv, lv + (rv - lv) * (frame - lf) / nullif(rf - lf, 0), lv, rv) AS fv FROM s)"""


@query("gap_fill", with_views("series", body=_FILLED + " SELECT event_id, round(fv, 6) AS filled FROM filled"))
def gap_fill(spark, d):
    rows = views.series_rows(spark, d).withColumn("v", F.when(F.col("k") < 70, F.col("value")))
    return series.gap_fill(rows, USER, "v").select("event_id", F.round("filled", 6).alias("filled"))


@query("sliding_fft", with_views("series", body=_WHOLE + """
    , w AS (SELECT user_id, n, v, t, greatest(4, least(8, n)) AS win FROM (SELECT *, unnest(range(n)) AS t FROM arr)),
    s AS (SELECT *, least(win, n) AS len, greatest(0, least(n, greatest(0, t - win // 2) + win) - win) AS st FROM w),
    p AS (SELECT *, v[st + 1:st + len] AS part FROM s),
    f AS (SELECT user_id, t, k,
      list_sum(list_transform(range(len), lambda j: part[j + 1] * cos(2 * pi() * k * j / len))) AS re,
      list_sum(list_transform(range(len), lambda j: -part[j + 1] * sin(2 * pi() * k * j / len))) AS im FROM (SELECT *, unnest(range(len // 2 + 1)) AS k FROM p))
    SELECT user_id, t AS frame, round(max(sqrt(re * re + im * im)), 6) AS mag,
      round(arg_max(atan2(im, re), sqrt(re * re + im * im)), 6) AS phase FROM f GROUP BY ALL"""))
def sliding_fft(spark, d):
    rows = series.over_blocks(views.series_rows(spark, d), USER, "value", sequence.sliding_peak, 7, 7, "p")
    return rows.select("user_id", "frame", F.round("p.mag", 6).alias("mag"), F.round("p.phase", 6).alias("phase"))


@query("hankel_rows", with_views("frames", body=_ARR + """
    SELECT user_id, clip, CAST(i AS INTEGER) AS i, greatest(n - d + 1, 0) AS cols, round(coalesce(list_sum(v[i + 1:i + n - d + 1]), 0), 6) AS total
    FROM (SELECT *, unnest(range(d)) AS i FROM (SELECT *, greatest(2, least(8, n // 3)) AS d FROM arr))"""))
def hankel_rows(spark, d):
    rows = _arrays(spark, d)
    rows = rows.select(*CLIP, F.posexplode_outer(sequence.hankel(F.col("value"), sequence.short_delays(F.size("value")))).alias("i", "row"))
    total = F.aggregate("row", F.lit(0.0), lambda s, x: s + x)
    return rows.select(*CLIP, "i", F.size("row").cast("bigint").alias("cols"), F.round(total, 6).alias("total"))


def _kalman_sql(src: str, name: str) -> str:
    return f"""{name} AS (
      SELECT user_id, n, 1 AS t, v, p0 + k0 * (v[1] - p0) AS pos, k1 * (v[1] - p0) AS vel, (1 - k0) * a AS a,
        0.5 * ((1 - k0) * b + (b - k1 * a)) AS b, c - k1 * b AS c, [p0 + k0 * (v[1] - p0)] AS o FROM (
        SELECT *, a / (a + 0.015) AS k0, b / (a + 0.015) AS k1 FROM (SELECT user_id, n, v, v[1] AS p0, 2 + 0.0002 AS a, 1 + 0.0004 AS b, 1 + 0.0008 AS c FROM {src}))
      UNION ALL
      SELECT user_id, n, t + 1, v, pp + k0 * (v[t + 1] - pp), vel + k1 * (v[t + 1] - pp), (1 - k0) * a, 0.5 * ((1 - k0) * b + (b - k1 * a)), c - k1 * b,
        list_append(o, pp + k0 * (v[t + 1] - pp)) FROM (
        SELECT *, a / (a + 0.015) AS k0, b / (a + 0.015) AS k1 FROM (
          SELECT user_id, n, t, v, o, vel, pos + vel AS pp, a + 2 * b + c + 0.0002 AS a, b + c + 0.0004 AS b, c + 0.0008 AS c FROM {name} WHERE t < n)))"""


_SMOOTH = _kalman_sql("arr", "fw") + ", rev AS (SELECT user_id, n, list_reverse(o) AS v FROM fw WHERE t = n), " + _kalman_sql("rev", "bw") + """
    SELECT f.user_id, i AS frame, round((f.o[i + 1] + b.o[f.n - i]) / 2, 6) AS smooth
    FROM (SELECT *, unnest(range(n)) AS i FROM fw WHERE t = n) f JOIN (SELECT * FROM bw WHERE t = n) b ON f.user_id = b.user_id"""


@query("kalman_smooth", with_views("series", body=_WHOLE + ", " + _SMOOTH))
def kalman_smooth(spark, d):
    rows = series.kalman_smooth(views.series_rows(spark, d).select("user_id", "frame", "value"), USER, "value")
    return rows.select("user_id", "frame", F.round("smooth", 6).alias("smooth"))


@query("occlusion_smooth", with_views("series", body=_FILLED + """,
    arr AS (SELECT user_id, list(fv ORDER BY frame) AS v, count(*) AS n FROM filled WHERE fv IS NOT NULL GROUP BY ALL), """ + _SMOOTH))
def occlusion_smooth(spark, d):
    """Occluded frames (k of 70 and more) filled, then smoothed."""
    rows = views.series_rows(spark, d).select("user_id", "frame", F.when(F.col("k") < 70, F.col("value")).alias("v"))
    rows = series.kalman_smooth(rows, USER, "v").filter(F.col("smooth").isNotNull())
    return rows.select("user_id", "frame", F.round("smooth", 6).alias("smooth"))


@query("cwt_bands", with_views("frames", body=_ARR + """
    , sc AS (SELECT *, pow(greatest(n / 2.0, 2.0), m / 15.0) AS s, (n - 1) // 2 AS c FROM (SELECT *, unnest(range(16)) AS m FROM arr)),
    pt AS (SELECT *, unnest(range(n)) AS t FROM sc),
    cv AS (SELECT user_id, clip, m, t,
      list_sum(list_transform(range(greatest(0, t + c - n + 1), least(n - 1, t + c) + 1), lambda j: v[j + 1] * exp(-0.5 * pow((t + c - j - n // 2) / s, 2)) * cos(5.0 * (t + c - j - n // 2) / s))) AS re,
      list_sum(list_transform(range(greatest(0, t + c - n + 1), least(n - 1, t + c) + 1), lambda j: v[j + 1] * exp(-0.5 * pow((t + c - j - n // 2) / s, 2)) * sin(5.0 * (t + c - j - n // 2) / s))) AS im FROM pt)
    SELECT user_id, clip, CAST(t * 4 + m // 4 AS INTEGER) AS i, round(avg(sqrt(re * re + im * im)) * pow(pi(), -0.25), 6) AS x FROM cv GROUP BY user_id, clip, t, m // 4"""))
def cwt_bands(spark, d):
    rows = _arrays(spark, d).withColumn("bands", sequence.cwt_bands(F.col("value")))
    return rows.select(*CLIP, F.posexplode_outer("bands").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("hankel_dmd")
def hankel_dmd(spark, d):
    rows = _arrays(spark, d).withColumn("energy", sequence.kinetic_energy(F.col("value")))
    return series.dynamic_modes(rows, [*CLIP, "energy"], F.col("value")).select(*CLIP, F.posexplode("spectrum").alias("i", "x"), "energy")


@query("kinetic_energy", with_views("frames", body="""
    , v AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id, clip ORDER BY frame), 0) AS dv FROM frames)
    SELECT user_id, clip, round(sqrt(avg(dv * dv)), 6) AS energy FROM v GROUP BY ALL"""))
def kinetic_energy(spark, d):
    return _arrays(spark, d).select(*CLIP, F.round(sequence.kinetic_energy(F.col("value")), 6).alias("energy"))


@query("rolling_loss", with_views("series", body="""
    SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 7) AS rolling FROM series"""))
def rolling_loss(spark, d):
    rows = series.rolling_mean(views.series_rows(spark, d), USER, "value")
    return rows.select("event_id", F.round("rolling", 7).alias("rolling"))


@query("best_epoch", with_views("series", body="""
    , t AS (SELECT *, max(k) OVER (PARTITION BY user_id ORDER BY frame) AS top FROM series),
    b AS (SELECT *, max(CASE WHEN k = top THEN frame END) OVER (PARTITION BY user_id ORDER BY frame) AS best FROM t),
    s AS (SELECT *, min(CASE WHEN frame - best >= 10 THEN frame END) OVER (PARTITION BY user_id) AS stop FROM b)
    SELECT user_id, max(k) AS best_score, max(best) AS best_epoch, max(frame) AS last_epoch, bool_or(stop IS NOT NULL) AS stopped_early
    FROM s WHERE stop IS NULL OR frame <= stop GROUP BY ALL"""))
def best_epoch(spark, d):
    return series.best_epoch(views.series_rows(spark, d), USER, "k", 10)


@query("frame_decimation", with_views("frames", body="""
    , s AS (SELECT *, greatest(1, CAST(round_even((CASE WHEN first_value(k) OVER w = 0 THEN 30.0 ELSE first_value(k) OVER w END) / 15.0, 0) AS INTEGER)) AS stride
      FROM frames WINDOW w AS (PARTITION BY user_id, clip ORDER BY frame))
    SELECT event_id, stride FROM s WHERE frame % stride = 0 AND frame / stride < 256"""))
def frame_decimation(spark, d):
    rows = views.frames(spark, d)
    fps = F.first("k").over(series.clip_window(USER))
    rows = rows.withColumn("stride", sequence.auto_stride(fps))
    return rows.filter(sequence.keep_frame(F.col("frame"), F.col("stride"))).select("event_id", "stride")


@query("extract_steps", with_views("clips", body="""
    , f AS (SELECT video_rel AS path, n_frames, CASE WHEN k = 0 THEN 30.0 ELSE CAST(k AS DOUBLE) END AS fps FROM clips),
    s AS (SELECT *, greatest(1, CAST(round_even(fps / 15.0, 0) AS INTEGER)) AS stride FROM f)
    SELECT path, CAST(ceil(n_frames / stride) AS BIGINT) AS n_frames, round(fps / stride, 6) AS fps, NULL AS error FROM s WHERE n_frames > 0
    UNION ALL SELECT path, NULL, NULL, 'ValueError: no frames' FROM s WHERE n_frames = 0"""))
def extract_steps(spark, d):
    """Decimated length and rate of every clip; empty clips end in the log of failures and the others go on."""

    def decimate(row):
        if not row["n_frames"]:
            raise ValueError("no frames")
        fps = float(row["k"] or 30)
        stride = max(1, round(fps / 15))
        return {"n_frames": -(-row["n_frames"] // stride), "fps": round(fps / stride, 6)}

    rows = views.clips(spark, d).select(F.col("video_rel").alias("path"), "n_frames", "k")
    done, failed = guarded(rows, decimate, "path string, n_frames bigint, fps double")
    return done.unionByName(failed, allowMissingColumns=True)


@query("fourier_map", with_views("emb", body="""
    SELECT vec_id, round(list_sum(list_transform(vec, lambda x: x + sin(pi() * x) + sin(2 * pi() * x) + cos(pi() * x) + cos(2 * pi() * x))), 6) AS total,
      round(list_sum(list_transform(range(len(vec)), lambda i: (i + 1) * sin(2 * pi() * vec[i + 1]))), 6) AS second_sines FROM emb"""))
def fourier_map(spark, d):
    """All values of a vector; the sums see every wave, and the places of the second sines."""
    rows = views.embeddings(spark, d).select("vec_id", F.size("vec").alias("n"), sequence.fourier_map(F.col("vec"), 2).alias("c"))
    sums = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    seconds = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("c", F.col("n") + 2 * i + 1) * (i + 1))
    return rows.select("vec_id", sums(F.col("c")).alias("total"), sums(seconds).alias("second_sines"))


def _unit(salt: str) -> str:
    return f"(('0x' || md5({salt})[1:12])::BIGINT / 281474976710656.0)"


_WARP_SALT = "'9|' || user_id || '|' || clip || '|' || copy || '|"


@query("augment_warp", with_views("frames", body=_ARR + f"""
    , c AS (SELECT *, 0.8 + 0.4 * {_unit(_WARP_SALT + "speed'")} AS speed, (-0.15 + 0.3 * {_unit(_WARP_SALT + "shift'")}) * n AS shift
      FROM (SELECT *, unnest([0, 1, 2]) AS copy FROM arr))
    SELECT user_id, clip, CAST(copy AS INTEGER) AS copy, CAST(i AS INTEGER) AS i, round(CASE WHEN n < 2 THEN v[1] ELSE
      v[1 + CAST(greatest(0, least(n - 1, round_even((i - (n - 1) / 2.0) * speed + (n - 1) / 2.0 + shift, 0))) AS INTEGER)] END, 6) AS x
    FROM (SELECT *, unnest(range(n)) AS i FROM c)"""))
def augment_warp(spark, d):
    rows = augment.copies(_arrays(spark, d), 3)
    salt = (9, F.col("user_id"), F.col("clip"), F.col("copy"))
    speed, shift = augment.warp_params(F.size("value"), *salt)
    rows = rows.withColumn("speed", speed).withColumn("shift", shift)
    warped = augment.time_warp(F.col("value"), F.col("speed"), F.col("shift"))
    return rows.select(*CLIP, "copy", F.posexplode_outer(warped).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("augment_noise", with_views("frames", body=_ARR + f"""
    SELECT user_id, clip, CAST(i AS INTEGER) AS i, round(CASE WHEN v[i + 1] <> 0 THEN v[i + 1] + 0.01 * g ELSE v[i + 1] END, 6) AS added,
      round(v[i + 1] * (1 + 0.05 * g), 6) AS scaled FROM (
      SELECT *, sqrt(-2 * ln(greatest({_unit("'4|' || user_id || '|' || clip || '|' || i || '|u1'")}, 1e-12))) * cos(2 * pi() * {_unit("'4|' || user_id || '|' || clip || '|' || i || '|u2'")}) AS g
      FROM (SELECT *, unnest(range(n)) AS i FROM arr))"""))
def augment_noise(spark, d):
    salt = (4, F.col("user_id"), F.col("clip"))
    both = F.arrays_zip(
        augment.coordinate_noise(F.col("value"), 0.01, *salt).alias("a"), augment.feature_noise(F.col("value"), 0.05, *salt).alias("s")
    )
    rows = _arrays(spark, d).select(*CLIP, F.posexplode_outer(both).alias("i", "b"))
    return rows.select(*CLIP, "i", F.round("b.a", 6).alias("added"), F.round("b.s", 6).alias("scaled"))


def _sums(rows, *keys, **frames):
    """Keys and, of each named frame, position-weighted coordinate sums, which see every change of order or value.

    Computed frames are exploded first, as Spark evaluates no lambda inside the argument of a Python function.
    """
    if not all(isinstance(f, str) for f in frames.values()):
        computed = F.array(F.struct(*[F.col(f).alias(n) if isinstance(f, str) else f.alias(n) for n, f in frames.items()]))
        rows = rows.select(*keys, F.explode_outer(computed).alias("_f"))
        keys = [c for c in rows.columns if c != "_f"]
        frames = {name: f"_f.{name}" for name in frames}
    made = rows.select(*keys, *[points.weighted_sums(F.col(f)).alias(name) for name, f in frames.items()])
    sums = [F.round(F.col(name)[c], 6).alias(f"{name}_{c}") for name in frames for c in "xyz"]
    return made.select(*[c for c in made.columns if c not in frames], *sums)


def _each_frame(rows, *keys):
    """One row per frame of the clips: keys, t, f."""
    return rows.select(*keys, F.posexplode_outer("frames").alias("t", "f"))


_PT = """, pt AS (SELECT vec_id, t, j, CASE WHEN j BETWEEN 33 AND 74 AND (t + vec_id) % 4 = 0 THEN NULL ELSE [vec[1 + (3 * j + 8 * t) % 64],
      vec[1 + (3 * j + 8 * t + 1) % 64], vec[1 + (3 * j + 8 * t + 2) % 64]] END AS p
    FROM emb CROSS JOIN (SELECT unnest(range(8)) AS t) CROSS JOIN (SELECT unnest(range(543)) AS j))"""
_RED = f", red AS (SELECT unnest({points.reduced_rows()}) AS j, unnest(range(119)) AS o)"
_JNT = f", jnt AS (SELECT unnest({points.joint_rows()}) AS j, unnest(range(27)) AS o)"
_WSUM = "round(coalesce(sum({p}[1] * (o + 1)), 0), 6) AS {n}_x, round(coalesce(sum({p}[2] * (o + 1)), 0), 6) AS {n}_y, round(coalesce(sum({p}[3] * (o + 1)), 0), 6) AS {n}_z"


@query("point_layouts", with_views("emb", body=_PT + _RED + _JNT + f""",
    a AS (SELECT vec_id, t, {_WSUM.format(p='p', n='storage')} FROM (SELECT *, CASE WHEN j < 468 THEN j + 75 WHEN j < 489 THEN j - 468 + 33 WHEN j < 522 THEN j - 489 ELSE j - 522 + 54 END AS o FROM pt) GROUP BY vec_id, t),
    b AS (SELECT vec_id, t, {_WSUM.format(p='p', n='reduced')} FROM pt JOIN red USING (j) GROUP BY vec_id, t),
    c AS (SELECT vec_id, t, {_WSUM.format(p='p', n='joints')} FROM pt JOIN jnt USING (j) GROUP BY vec_id, t)
    SELECT * REPLACE (CAST(t AS INTEGER) AS t), true AS inverse FROM a JOIN b USING (vec_id, t) JOIN c USING (vec_id, t)"""))
def point_layouts(spark, d):
    rows = _each_frame(views.point_clips(spark, d), "vec_id")
    stored = rows.withColumn("s", points.from_face_first(F.col("f")))
    same = points.to_face_first(F.col("s")).eqNullSafe(F.col("f"))
    return _sums(stored, "vec_id", "t", same.alias("inverse"), storage="s", reduced=points.reduced(F.col("f")), joints=points.joints(F.col("f")))


@query("normalize_position", with_views("emb", body=_PT + f""",
    k AS (SELECT vec_id, t, max(p[1]) FILTER (j = 23) AS ax, max(p[2]) FILTER (j = 23) AS ay, max(p[3]) FILTER (j = 23) AS az, max(p[1]) FILTER (j = 24) AS bx, max(p[2]) FILTER (j = 24) AS b_y,
      max(p[3]) FILTER (j = 24) AS bz, max(p[1]) FILTER (j = 11) AS lx, max(p[2]) FILTER (j = 11) AS ly, max(p[1]) FILTER (j = 12) AS rx, max(p[2]) FILTER (j = 12) AS ry FROM pt GROUP BY vec_id, t),
    o AS (SELECT vec_id, t, (ax + bx) / 2 AS ox, (ay + b_y) / 2 AS oy, (az + bz) / 2 AS oz, CASE WHEN sqrt((lx - rx) ** 2 + (ly - ry) ** 2) < 1e-3 THEN 1 ELSE sqrt((lx - rx) ** 2 + (ly - ry) ** 2) END AS s FROM k)
    SELECT vec_id, CAST(t AS INTEGER) AS t, {_WSUM.format(p='q', n='moved')} FROM (SELECT vec_id, t, j AS o, [(p[1] - ox) / s, (p[2] - oy) / s, (p[3] - oz) / s] AS q FROM pt JOIN o USING (vec_id, t) WHERE p IS NOT NULL) GROUP BY vec_id, t"""))
def normalize_position(spark, d):
    rows = _each_frame(views.point_clips(spark, d), "vec_id")
    rows = rows.select("vec_id", "t", points.normalize_positions(F.col("f"), fill=True).alias("f"))
    return _sums(rows, "vec_id", "t", moved="f")


@query("bones", with_views("emb", body=_PT + _JNT + f""",
    pr AS (SELECT unnest({[c for _, c in dict((c, (p, c)) for p, c in points.bone_pairs()).values()]}) AS c, unnest({[p for p, _ in dict((c, (p, c)) for p, c in points.bone_pairs()).values()]}) AS a),
    f AS (SELECT vec_id, t, o, coalesce(p, [0.0, 0.0, 0.0]) AS p FROM pt JOIN jnt USING (j)),
    b AS (SELECT x.vec_id, x.t, x.o, [x.p[1] - y.p[1], x.p[2] - y.p[2], x.p[3] - y.p[3]] AS q FROM f x JOIN pr ON x.o = pr.c JOIN f y ON y.vec_id = x.vec_id AND y.t = x.t AND y.o = pr.a)
    SELECT vec_id, CAST(t AS INTEGER) AS t, {_WSUM.format(p='q', n='bone')} FROM b GROUP BY vec_id, t"""))
def bones(spark, d):
    rows = _each_frame(views.point_clips(spark, d), "vec_id").select("vec_id", "t", points.zero_missing(points.joints(F.col("f"))).alias("f"))
    return _sums(rows, "vec_id", "t", bone=points.bones(F.col("f")))


@query("hand_shapes", with_views("emb", body=_PT + f""",
    h AS (SELECT vec_id, t, CASE WHEN j < 54 THEN 'left' ELSE 'right' END AS hand, (j - 33) % 21 AS o, [CASE WHEN j < 54 THEN -p[1] ELSE p[1] END, p[2], p[3]] AS p
      FROM pt WHERE j BETWEEN 33 AND 74),
    l AS (SELECT h.vec_id, h.t, h.hand, h.o, CASE WHEN h.p[1] IS NULL THEN [0.0, 0.0, 0.0] ELSE [h.p[1] - w.p[1], h.p[2] - w.p[2], h.p[3] - w.p[3]] END AS q, h.p[1] IS NOT NULL AS seen
      FROM h JOIN h w ON w.vec_id = h.vec_id AND w.t = h.t AND w.hand = h.hand AND w.o = 0),
    s AS (SELECT vec_id, t, hand, greatest(max(sqrt(q[1] ** 2 + q[2] ** 2)), 1e-3) AS size, bool_or(seen) AS seen FROM l GROUP BY ALL)
    SELECT vec_id, CAST(t AS INTEGER) AS t, hand, {_WSUM.format(p='r', n='shape')}, any_value(seen) AS seen FROM (
      SELECT l.vec_id, l.t, l.hand, o, [q[1] / size, q[2] / size, q[3] / size] AS r, s.seen FROM l JOIN s USING (vec_id, t, hand)) GROUP BY vec_id, t, hand"""))
def hand_shapes(spark, d):
    """Both hands of all frames; the left one is mirrored."""
    rows = _each_frame(views.point_clips(spark, d), "vec_id")
    part = lambda at: points.zero_missing(F.slice("f", at + 1, fixed.N_HAND))
    one = lambda name, h, mirror: F.struct(
        F.lit(name).alias("hand"), points.hand_shape(h, mirror=mirror).alias("h"), points.hand_seen(h).alias("seen")
    )
    both = F.array(one("left", part(points.LEFT), True), one("right", part(points.LEFT + fixed.N_HAND), False))
    rows = rows.select("vec_id", "t", F.explode_outer(both).alias("b"))
    return _sums(rows, "vec_id", "t", "b.hand", "b.seen", shape="b.h")


@query("face_relative", with_views("emb", body=_PT + _RED + f""",
    f AS (SELECT vec_id, t, o - 75 AS o, p FROM pt JOIN red USING (j) WHERE o >= 75),
    q AS (SELECT f.vec_id, f.t, f.o, [f.p[1] - n.p[1], f.p[2] - n.p[2], f.p[3] - n.p[3]] AS q FROM f JOIN f n ON n.vec_id = f.vec_id AND n.t = f.t AND n.o = 40)
    SELECT vec_id, CAST(t AS INTEGER) AS t, {_WSUM.format(p='q', n='face')} FROM q GROUP BY vec_id, t"""))
def face_relative(spark, d):
    frame = points.zero_missing(points.reduced(F.col("f")))
    rows = _each_frame(views.point_clips(spark, d), "vec_id").select("vec_id", "t", F.slice(frame, points.FACE + 1, 44).alias("f"))
    return _sums(rows, "vec_id", "t", face=points.face_relative(F.col("f")))


@query("center_joints", with_views("emb", body=_PT + _JNT + """,
    f AS (SELECT vec_id, t, o, coalesce(p, [0.0, 0.0, 0.0]) AS p FROM pt JOIN jnt USING (j)),
    c AS (SELECT f.vec_id, f.t, f.o, [f.p[1] - r.p[1], f.p[2] - r.p[2], f.p[3] - r.p[3]] AS q FROM f JOIN f r ON r.vec_id = f.vec_id AND r.t = f.t AND r.o = 0),
    w AS (SELECT a.vec_id, avg(sqrt((a.q[1] - b.q[1]) ** 2 + (a.q[2] - b.q[2]) ** 2 + (a.q[3] - b.q[3]) ** 2)) AS w
      FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.t = b.t AND a.o = 1 AND b.o = 2 GROUP BY 1)
    SELECT vec_id, CAST(t AS INTEGER) AS t, round(sum(q[1] * (o + 1)) / any_value(w), 6) AS j_x, round(sum(q[2] * (o + 1)) / any_value(w), 6) AS j_y,
      round(sum(q[3] * (o + 1)) / any_value(w), 6) AS j_z FROM c JOIN w USING (vec_id) GROUP BY vec_id, t"""))
def center_joints(spark, d):
    ready = F.transform("frames", lambda f: points.zero_missing(points.joints(f)))
    rows = views.point_clips(spark, d).select("vec_id", ready.alias("fs"))
    rows = rows.select("vec_id", F.posexplode_outer(points.center_joints(F.col("fs"))).alias("t", "f"))
    return _sums(rows, "vec_id", "t", j="f")


_INPUT = _PT + _RED + """,
    hs AS (SELECT vec_id, t FROM pt WHERE j = 33 AND p IS NOT NULL),
    sp AS (SELECT vec_id, min(t) AS a, max(t) AS z FROM hs GROUP BY 1),
    fr AS (SELECT vec_id, i, a + least(i, z - a) AS t FROM sp CROSS JOIN (SELECT unnest(range(30)) AS i)),
    k AS (SELECT vec_id, t, max(p[1]) FILTER (j = 23) AS ax, max(p[2]) FILTER (j = 23) AS ay, max(p[3]) FILTER (j = 23) AS az, max(p[1]) FILTER (j = 24) AS bx, max(p[2]) FILTER (j = 24) AS b_y,
      max(p[3]) FILTER (j = 24) AS bz, max(p[1]) FILTER (j = 11) AS lx, max(p[2]) FILTER (j = 11) AS ly, max(p[1]) FILTER (j = 12) AS rx, max(p[2]) FILTER (j = 12) AS ry FROM pt WHERE j < 33 GROUP BY ALL),
    o AS (SELECT vec_id, t, (ax + bx) / 2 AS ox, (ay + b_y) / 2 AS oy, (az + bz) / 2 AS oz, CASE WHEN sqrt((lx - rx) ** 2 + (ly - ry) ** 2) < 1e-3 THEN 1 ELSE sqrt((lx - rx) ** 2 + (ly - ry) ** 2) END AS s FROM k),
    m AS (SELECT vec_id, t, sum(((p[1] - ox) * (3 * red.o + 1) + (p[2] - oy) * (3 * red.o + 2) + (p[3] - oz) * (3 * red.o + 3)) / s) AS total
      FROM pt JOIN red USING (j) JOIN o USING (vec_id, t) WHERE p IS NOT NULL GROUP BY ALL)
    SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(357 AS INTEGER) AS width, round(total, 5) AS total FROM fr JOIN m USING (vec_id, t)"""


@query("model_input", with_views("emb", body=_INPUT))
def model_input(spark, d):
    rows = views.point_clips(spark, d).select("vec_id", landmarks.model_input(F.col("frames")).alias("m"))
    rows = rows.select("vec_id", F.posexplode_outer("m").alias("i", "row"))
    total = F.aggregate(F.transform("row", lambda v, j: v * (j + 1)), F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", "i", F.size("row").alias("width"), F.round(total, 5).alias("total"))


@query("joint_spectrum")
def joint_spectrum(spark, d):
    """Per body part: dynamic modes of the filled, smoothed, centred joints, their spectrum, mode map by joint and kinetic energy."""
    rows = views.point_clips(spark, d).select("vec_id", F.transform("frames", points.joints).alias("fs"))
    rows = series.smooth_joints(rows, "fs").select("vec_id", points.center_joints(F.col("fs")).alias("fs"))
    parts = {"upper": (1, 7), "left_hand": (8, 10), "right_hand": (18, 10)}

    def flat(at, n):
        return F.flatten(F.transform("fs", lambda f: points.flat(F.slice(f, at, n))))

    made = [F.struct(F.lit(name).alias("part"), flat(at, n).alias("x"), F.lit(3 * n).alias("dim")) for name, (at, n) in parts.items()]
    rows = rows.select("vec_id", F.explode_outer(F.array(*made)).alias("p")).select("vec_id", "p.*")
    rows = rows.withColumn("energy", sequence.kinetic_energy(F.col("x"), F.col("dim")))
    return series.dynamic_modes(rows, ["vec_id", "part", "energy"], F.col("x"), F.col("dim"), coords=3).select("vec_id", "part", "spectrum", "modes", "energy")


def _normal(salt: str, axis: str) -> str:
    return f"(sqrt(-2 * ln(greatest({_unit(salt + axis + "|u1'")}, 1e-12))) * cos(2 * pi() * {_unit(salt + axis + "|u2'")}))"


_POINT_SALT = "'5|' || pt.vec_id || '|' || copy || '|' || pt.t || '|' || j || '|"


@query("augment_points", with_views("emb", body=_PT + f""",
    c AS (SELECT *, {_unit("'5|' || vec_id || '|' || copy || '|angle'")} AS u1, {_unit("'5|' || vec_id || '|' || copy || '|scale'")} AS u2, {_unit("'5|' || vec_id || '|' || copy || '|ax'")} AS u3,
      {_unit("'5|' || vec_id || '|' || copy || '|ay'")} AS u4, {_unit("'5|' || vec_id || '|' || copy || '|sx'")} AS u5, {_unit("'5|' || vec_id || '|' || copy || '|sy'")} AS u6
      FROM (SELECT *, unnest([0, 1]) AS copy FROM (SELECT DISTINCT vec_id FROM emb))),
    k AS (SELECT vec_id, copy, (2 * u1 - 1) * {math.radians(15)!r} AS t, 1 + (2 * u2 - 1) * 0.15 AS s, 1 + (2 * u3 - 1) * 0.08 AS ax, 1 + (2 * u4 - 1) * 0.08 AS ay,
      (2 * u5 - 1) * 0.1 AS sx, (2 * u6 - 1) * 0.1 AS sy FROM c)
    SELECT vec_id, CAST(copy AS INTEGER) AS copy, CAST(t AS INTEGER) AS t, {_WSUM.format(p='q', n='p')} FROM (
      SELECT k.vec_id, copy, pt.t, j AS o, [(p[1] * cos(k.t) - p[2] * sin(k.t)) * s * ax + sx + 0.01 * {_normal(_POINT_SALT, 'x')},
        (p[1] * sin(k.t) + p[2] * cos(k.t)) * s * ay + sy + 0.01 * {_normal(_POINT_SALT, 'y')}, p[3] * s + 0.01 * {_normal(_POINT_SALT, 'z')}] AS q
      FROM pt JOIN k USING (vec_id) WHERE j < 75 AND p IS NOT NULL) GROUP BY ALL"""))
def augment_points(spark, d):
    frame = points.zero_missing(points.pose_and_hands(F.col("f")))
    rows = augment.copies(_each_frame(views.point_clips(spark, d), "vec_id").select("vec_id", "t", frame.alias("f")), 2)
    moved = augment.augment_points(F.col("f"), 5, F.col("vec_id"), F.col("copy"), frame_no=F.col("t"))
    return _sums(rows.select("vec_id", "copy", "t", moved.alias("f")), "vec_id", "copy", "t", p="f")


@query("detection_rates", with_views("emb", body="""
    , s AS (SELECT vec_id, label FROM emb QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('0|' || vec_id), vec_id) <= 40),
    r AS (SELECT label, vec_id, avg(CASE WHEN (t + vec_id) % 4 = 0 THEN 0 ELSE 1 END) AS h FROM s CROSS JOIN (SELECT unnest(range(8)) AS t) GROUP BY ALL)
    SELECT CAST(label AS VARCHAR) AS source, count(*) AS clips_sampled, 100.0 AS pose_pct, round(100 * avg(h), 6) AS left_hand_pct, round(100 * avg(h), 6) AS right_hand_pct, 100.0 AS face_pct
    FROM r GROUP BY label"""))
def detection_rates(spark, d):
    rows = views.point_clips(spark, d).select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("source"), "frames")
    out = reports.detection_rates(rows)
    return out.select("source", "clips_sampled", *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("_pct")])


@query("landmark_frames", with_views("emb", body=f"""
    , pt AS (SELECT vec_id, j, [vec[1 + (3 * j) % 64], vec[1 + (3 * j + 1) % 64], vec[1 + (3 * j + 2) % 64]] AS p FROM emb CROSS JOIN (SELECT unnest(range(543)) AS j))
    SELECT vec_id, {_WSUM.format(p='p', n='storage')} FROM (
      SELECT *, CASE WHEN j < 468 THEN j + 75 WHEN j < 489 THEN j - 468 + 33 WHEN j < 522 THEN j - 489 ELSE j - 522 + 54 END AS o FROM pt) GROUP BY 1"""))
def landmark_frames(spark, d):
    """Long landmark rows (one per point) gathered into checked dense frames in storage order."""
    j = F.col("j")
    kind = F.when(j < 468, "face").when(j < 489, "left_hand").when(j < 522, "pose").otherwise("right_hand")
    first = F.when(j < 468, 0).when(j < 489, 468).when(j < 522, 489).otherwise(522)
    rows = views.embeddings(spark, d).select("vec_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(542))).alias("j"))
    coord = lambda c: F.get("vec", F.pmod(3 * j + c, F.lit(64)))
    long = rows.select(
        F.col("vec_id").alias("seq"), F.lit(0).alias("frame"), kind.alias("type"), (j - first).alias("landmark_index"),
        coord(0).alias("x"), coord(1).alias("y"), coord(2).alias("z"),
    )
    good, _ = landmarks.dense_frames(long)
    return _sums(good, F.col("seq").alias("vec_id"), storage="points")


_BANK = """
    , e AS (SELECT user_id, clip, sqrt(avg(dv * dv)) AS energy FROM (
      SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id, clip ORDER BY frame), 0) AS dv FROM frames) GROUP BY ALL),
    bank AS (
      SELECT user_id, clip, 'value' AS modality, v AS f FROM arr
      UNION ALL SELECT user_id, clip, 'energy', [energy] FROM e
      UNION ALL SELECT user_id, clip, 'resampled', list_transform(range(30), lambda i: v[1 + CASE WHEN n >= 30 THEN (i * (n - 1)) // 29 ELSE least(i, n - 1) END]) FROM arr
      UNION ALL SELECT user_id, clip, 'doubled', list_transform(v, lambda x: 2 * x + 1) FROM arr)"""


def _bank(spark, d):
    known = features.standard()
    known.register("doubled", features.user_transform(lambda x: 2 * x + 1))
    return features.feature_table(_arrays(spark, d), CLIP, "value", known)


@query("feature_bank", with_views("frames", body=_ARR + _BANK + """
    SELECT user_id, clip, modality, CAST(len(f) AS BIGINT) AS n, round(list_sum(f), 4) AS total FROM bank"""))
def feature_bank(spark, d):
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return _bank(spark, d).select(*CLIP, "modality", "n", F.round(total, 4).alias("total"))


@query("user_transform", with_views("frames", body=_ARR + """
    SELECT user_id, clip, CAST(i - 1 AS INTEGER) AS i, round(2 * v[i] + 1, 6) AS x FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM arr)"""))
def user_transform(spark, d):
    doubled = features.user_transform(lambda x: 2 * x + 1)
    return _long(_arrays(spark, d), doubled(F.col("value")))


@query("bank_scores", with_views("frames", body=_ARR + _BANK + """
    SELECT user_id, clip, modality, round(list_max(f) - list_min(f), 6) AS score FROM bank"""))
def bank_scores(spark, d):
    scored = features.score_table(_bank(spark, d), CLIP, lambda rows: rows.max(1) - rows.min(1))
    return scored.withColumn("score", F.round("score", 6))
