"""Scalar functions, statistics and sequence expressions against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions import points, sequence, stats, text
from glossloom.functions.hashing import hamming_hex, in_shard, parse_shard
from glossloom.operators import series
from glossloom.plans import seqs, views
from glossloom.sources.clips import quality_score

# Published discordant counts and p-values.
MCNEMAR = [(1, 20, 2.09808e-05), (19, 104, 2.21987e-15), (1, 12, 0.00341797), (19, 92, 1.12361e-12), (2, 16, 0.00131226), (4, 11, 0.118469), (0, 0, 1.0)]
# Published successes, trials and rounded 95 % bounds.
WILSON = [(79, 114, 0.603, 0.770), (78, 114, 0.594, 0.762), (44, 114, 0.302, 0.478)]


def one(spark, column, **values):
    df = spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(column.alias("r")).first().r


def test_mcnemar_golden(spark):
    df = spark.createDataFrame(MCNEMAR, "b long, c long, want double")
    for r in df.withColumn("p", stats.mcnemar_p(F.col("b"), F.col("c"))).collect():
        assert f"{r.p:.6g}" == f"{r.want:.6g}"


def test_mcnemar_large(spark):
    b, c = 900, 1100
    n = b + c
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(b + 1)) / 2**n)
    assert one(spark, stats.mcnemar_p(F.lit(b), F.lit(c))) == pytest.approx(want, rel=1e-9)
    assert one(spark, stats.mcnemar_p(F.lit(5000000), F.lit(5000000))) == pytest.approx(1.0, abs=1e-3)


def test_wilson(spark):
    df = spark.createDataFrame(WILSON, "k int, n int, lo double, hi double").withColumn("w", stats.wilson(F.col("k"), F.col("n")))
    for r in df.collect():
        assert (round(r.w.low, 3), round(r.w.high, 3)) == (r.lo, r.hi)
    empty = one(spark, stats.wilson(F.lit(0), F.lit(0)))
    clamped = one(spark, stats.wilson(F.lit(0), F.lit(0), clamp=True))
    assert empty.low is None and (clamped.p, clamped.low) == (0.0, 0.0)


def test_bootstrap_matches_row_resampling(spark):
    b, c, n = 30, 60, 400
    got = one(spark, stats.paired_bootstrap(F.lit(b), F.lit(c), F.lit(n), 4000))
    d = np.array([-1] * b + [1] * c + [0] * (n - b - c))
    rng = np.random.default_rng(0)
    boots = d[rng.integers(0, n, (4000, n))].mean(1)
    assert got.delta == pytest.approx(d.mean())
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(boots, [0.025, 0.975])), abs=0.008)


def test_bootstrap_macro(spark):
    rnd = random.Random(0)
    pairs = [(rnd.randrange(4), rnd.randrange(4)) for _ in range(300)] + [(k, k) for k in range(4)] * 40
    y, p = map(np.array, zip(*pairs))
    cells = spark.createDataFrame(pairs, "y int, pred int").groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    packed = cells.agg(F.array_sort(F.collect_list(F.struct("y", "pred", "n"))).alias("cells"))
    got = packed.select(stats.bootstrap_metric(F.col("cells"), "macro_acc", 1500).alias("r")).first().r
    point = np.mean([(p[y == k] == k).mean() for k in range(4)])
    rng = np.random.default_rng(1)
    boots = []
    for _ in range(1500):
        i = rng.integers(0, len(y), len(y))
        boots.append(np.mean([(p[i][y[i] == k] == k).mean() for k in range(4)]))
    assert got.point == pytest.approx(point)
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(boots, [0.025, 0.975])), abs=0.012)


@pytest.mark.parametrize(
    "raw, want",
    [("Thank_You", "thank you"), (" ThankYou ", "thank you"), ("Caf\u00e9-Bar/\u212b!", "caf\u00e9 bar \u00e5"), ("\uff28\uff25\uff2c\uff2c\uff2f", "hello"), ("good  morning", "good morning")],
)
def test_normalize_label(spark, raw, want):
    assert one(spark, text.normalize_label(F.col("t")), t=raw) == want


def test_text_rules(spark):
    cases = [
        (text.normalize_gloss(F.col("t")), "48. Hello (sign 2)", "hello"), (text.normalize_gloss(F.col("t")), "12) Don't_Know", "don't know"),
        (text.strip_index(F.col("t")), "55. Thank you", "Thank you"), (text.dictionary_word(F.col("t")), "A/Apple - English.mp4", "apple"),
        (text.clip_counter(F.col("t")), "x/mvi_0042.MOV", 42.0), (text.clip_counter(F.col("t")), "x/a.mov", None),
        (text.label_from_path(F.col("t")), "root/48. Hello/User12/videos/a.mp4", "hello"), (text.label_from_path(F.col("t")), "Word__session1__clip2.mp4", "word"),
        (text.label_from_path(F.col("t")), "train/stop_clip_7.mp4", "stop"), (text.corpus_relative(F.col("t")), "C:\\x\\ISL_DATASET_8\\eat\\a.mp4", "eat/a.mp4"),
        (text.portable_path(F.col("t")), "/home/u/ISL_DATASET_40/eat/a.mp4", "ISL_DATASET_40/eat/a.mp4"), (text.portable_path(F.col("t")), "/home/u/eat/a.mp4", "eat/a.mp4"),
        (text.fewshot_identity(F.col("t"), F.lit("v/session3.mp4"), F.lit("n")), "User7", "signer:User7"),
        (text.fewshot_identity(F.col("t"), F.lit("v/session3.mp4"), F.lit("n")), "cat 1", "session:3"),
        (text.file_stem(F.col("t")), "a/.hidden", ".hidden"), (text.output_name(F.col("t"), F.lit("src"), F.lit(7), F.lit("a/b.mov")), "thank you", "thank_you__src__00007__b.mp4"),
    ]
    for column, raw, want in cases:
        assert one(spark, column, t=raw) == want, raw


def test_clip_key(spark):
    import hashlib

    rel = "A b/MVI (1).mp4"
    want = "src_MVI_1_" + hashlib.sha1(f"src/{rel}".encode()).hexdigest()[:10]
    assert one(spark, text.clip_key(F.lit("src"), F.col("t")), t=rel) == want


def test_shards_cover_all_keys_once(spark):
    import zlib

    keys = [f"k{i}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    parts = [{r.k for r in df.filter(in_shard(F.col("k"), parse_shard(f"{i}/4"))).collect()} for i in range(4)]
    assert sum(map(len, parts)) == 200 and parts[1] == {k for k in keys if zlib.crc32(k.encode()) % 4 == 1}
    with pytest.raises(ValueError):
        parse_shard("4/4")


def test_hamming(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0" * 16, 64), ("8" + "0" * 15, "0" * 16, 1), ("", "00", 64), ("0f", "0e", 1), ("1", "00", 64)], "a string, b string, w int")
    assert all(r.d == r.w for r in df.withColumn("d", hamming_hex(F.col("a"), F.col("b"))).collect())


def test_quality(spark):
    q = lambda *a: one(spark, quality_score(*[F.lit(x) for x in a]))
    assert q(640, 480, 30, 2.0, 100, True) == 1.0 and q(300, 300, 15, 2.0, 10, True) == 0.55
    assert q(100, 100, 5, 60.0, 10, True) == 0.0 and q(640, 480, 30, 2.0, 100, False) == 0.0


def series_of(n, seed=0):
    rng = np.random.default_rng(seed)
    return (np.sin(np.arange(n) / 3) * 2 + rng.normal(0, 0.3, n) + 1).tolist()


def apply(spark, fn, x):
    return spark.createDataFrame([(x,)], "x array<double>").select(fn(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("n", [1, 5, 29, 30, 77, 256])
def test_resample(spark, n):
    x = [float(i) for i in range(n)]
    want = np.linspace(0, n - 1, 30).astype(int) if n >= 30 else np.minimum(np.arange(30), n - 1)
    assert apply(spark, sequence.resample, x) == [float(i) for i in want]


@pytest.mark.parametrize("n", [3, 6, 40])
def test_sliding_peak(spark, n):
    x = np.array(series_of(n))
    got = apply(spark, sequence.sliding_peak, x.tolist())
    win = max(4, min(8, n))
    for t, g in enumerate(got):
        end = min(n, max(0, t - win // 2) + win)
        spec = np.fft.rfft(x[max(0, end - win) : end])
        k = np.abs(spec).argmax()
        assert g.mag == pytest.approx(np.abs(spec)[k]) and g.phase == pytest.approx(np.angle(spec)[k], abs=1e-9)


def kalman_matrix(z, q=8e-4, r=1.5e-2):
    """Textbook form with matrices."""
    f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
    noise = q * np.array([[0.25, 0.5], [0.5, 1.0]])
    s, p, out = np.array([z[0], 0.0]), np.eye(2), []
    for v in z:
        s, p = f @ s, f @ p @ f.T + noise
        k = p @ h.T / (h @ p @ h.T + r)
        s = s + (k * (v - s[0])).ravel()
        p = (np.eye(2) - k @ h) @ p
        p = (p + p.T) / 2
        out.append(s[0])
    return np.array(out)


def test_kalman(spark):
    x = series_of(60)
    forward = kalman_matrix(x)
    want = (forward + kalman_matrix(forward[::-1])[::-1]) / 2
    assert apply(spark, sequence.kalman_smooth, x) == pytest.approx(want.tolist(), rel=1e-9)


def test_cwt(spark):
    x = np.array(series_of(32))
    got = np.array(apply(spark, sequence.cwt_bands, x.tolist())).reshape(32, 4)
    scales = np.geomspace(1, 16, 16)
    t = np.arange(32) - 16
    full = np.array([np.abs(np.convolve(x, np.pi**-0.25 * np.exp(5j * t / s) * np.exp(-0.5 * (t / s) ** 2), "same")) for s in scales])
    assert np.allclose(got, full.reshape(4, 4, 32).mean(1).T)


def test_modes_of_a_known_oscillation():
    t = np.arange(60)
    found = sequence.delay_modes((np.cos(0.4 * t) * 0.98**t).reshape(1, -1, 1), 8, 2)[0]
    eig = np.array(found["re"]) + 1j * np.array(found["im"])
    assert sorted(np.angle(eig)) == pytest.approx([-0.4, 0.4], abs=1e-6) and np.abs(eig) == pytest.approx([0.98, 0.98], abs=1e-6)
    assert set(sequence.delay_modes(np.zeros((1, 3, 1)), 8, 3)[0]["re"]) == {0.0}
    x = np.random.default_rng(8).normal(size=(3, 40, 2))
    for clip, made in zip(x, sequence.delay_modes(x, 4, 3)):  # the same steps by singular value decomposition
        h = np.concatenate([clip.T[:, i : 37 + i] for i in range(4)])
        u, s, v = np.linalg.svd(h[:, :-1], full_matrices=False)
        want = np.linalg.eigvals(u[:, :3].T @ h[:, 1:] @ v[:3].T / s[:3])
        assert np.allclose(np.sort_complex(want), np.sort_complex(made["re"] + 1j * made["im"]))


def test_fourier_and_hankel(spark):
    assert apply(spark, lambda c: sequence.fourier_map(c, 2), [0.25]) == pytest.approx(
        [0.25, math.sin(math.pi / 4), 1.0, math.cos(math.pi / 4), 0.0], abs=1e-12
    )
    assert apply(spark, lambda c: sequence.hankel(c, 3), [1.0, 2.0, 3.0, 4.0]) == [[1.0, 2.0], [2.0, 3.0], [3.0, 4.0]]


def test_point_tables():
    assert len(points.reduced_rows()) == 119 and len(points.joint_rows()) == 27
    assert len(fixed.SKELETON_EDGES) == 33
    parent = {c: p for p, c in points.bone_pairs()}
    assert parent[2] == 1 and parent[5] == 3 and parent[7] == 5 and parent[13] == 11


def test_stride(spark):
    df = spark.createDataFrame([(0.0, 2), (30.0, 2), (60.0, 4), (25.0, 2), (12.0, 1), (None, 2), (37.5, 2)], "fps double, want int")
    assert all(r.s == r.want for r in df.withColumn("s", sequence.auto_stride(F.col("fps"))).collect())


@pytest.mark.parametrize("x, want", [
    (lambda t: np.full(40, 50.0), [1]), (lambda t: 100 * 0.9**t, [0.9]), (lambda t: 3 * t + 2, [1, 1]), (lambda t: 5 * np.sin(0.4 * t), [np.exp(0.4j), np.exp(-0.4j)]),
    (lambda t: 100 * np.sin(0.4 * t) + 0.01 * np.cos(1.1 * t), [np.exp(1.1j), np.exp(-1.1j), np.exp(0.4j), np.exp(-0.4j)]),
])
def test_modes_of_simple_courses_have_no_noise_beside_them(x, want):
    found = sequence.delay_modes(x(np.arange(40.0)).reshape(1, -1, 1), 8, 6)[0]
    assert np.allclose(found["re"] + 1j * found["im"], [*want, *[0] * (6 - len(want))], atol=1e-5)


def odd_frames(spark):
    """Whole, short, empty and null frames with missing points, missing coordinates, zeros and NaN."""
    rnd = random.Random(3)

    def point():
        kind = rnd.randrange(12)
        xyz = [rnd.uniform(-2, 2) for _ in range(3)]
        return None if kind == 0 else (0.0, 0.0, 0.0) if kind == 1 else (xyz[0], None, xyz[2]) if kind == 2 else (math.nan, *xyz[1:]) if kind == 3 else tuple(xyz)

    frames = [[point() for _ in range(n)] for n in [543] * 40 + [30] * 80 + [24, 12, 1, 0]] + [None]
    return spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "i long, f array<struct<x:double,y:double,z:double>>")


def plain(row):
    return [None if p is None else [None if v is None else "nan" if math.isnan(v) else round(v, 9) for v in p] for p in row] if row is not None else None


@pytest.mark.parametrize("fill", [False, True])
def test_positions_in_batches_equal_those_of_single_frames(spark, monkeypatch, fill):
    monkeypatch.setattr(points, "PIECE", 7)
    df = odd_frames(spark)
    single = df.select("i", points.normalize_position(points.zero_missing(F.col("f")) if fill else F.col("f")).alias("f"))
    batch = df.select("i", points.normalize_positions(F.col("f"), fill).alias("f"))
    want, got = ({r.i: plain(r.f) for r in x.collect()} for x in (single, batch))
    assert len(want) == 125 and got == want


def test_augmented_frames_keep_missing_points_and_follow_the_salt(spark):
    from glossloom.operators import augment

    df = odd_frames(spark)
    moved = {r.i: r for r in df.select("i", "f", augment.augment_points(F.col("f"), 5, F.col("i"), frame_no=F.lit(2)).alias("m")).collect()}
    j = next(j for j, p in enumerate(moved[50].f) if p and None not in tuple(p) and p.z)
    noise = df.filter("i = 50").select(augment.gaussian(5, F.col("i"), 2, j, "z").alias("e"), (1 + augment.uniform(-0.15, 0.15, 5, F.col("i"), "scale")).alias("s")).first()
    for r in moved.values():
        assert (r.f is None) == (r.m is None) and len(r.f or []) == len(r.m or [])
        for a, b in zip(r.f or [], r.m or []):
            still = a is None or None in tuple(a) or tuple(a) == (0.0, 0.0, 0.0)
            assert (plain([a]) == plain([b])) == still
    assert moved[50].m[j].z == pytest.approx(moved[50].f[j].z * noise.s + 0.01 * noise.e, rel=1e-12)


def test_weighted_sums(spark):
    df = spark.createDataFrame([([(1.0, None, 2.0), None, (4.0, 1.0, -1.0)],), ([],), (None,)], "f array<struct<x:double,y:double,z:double>>")
    got = [r.s if r.s is None else tuple(r.s) for r in df.select(points.weighted_sums(F.col("f")).alias("s")).collect()]
    assert got == [(13.0, 3.0, -1.0), (0.0, 0.0, 0.0), None]


def test_clips_of_points_from_odd_vectors(spark, tmp_path):
    rows = [(1, [float(i) for i in range(64)], 0), (2, [1.0, None], 1), (4, None, 2), (None, [2.0] * 64, 3), (-4, [0.5] * 70, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in views.point_clips(spark, str(tmp_path)).collect()}
    assert {len(f) for r in got.values() for f in r.frames} == {543} and {len(r.frames) for r in got.values()} == {8}
    assert tuple(got[1].frames[3][40]) == (None,) * 3 and tuple(got[1].frames[2][40]) == tuple((3 * 40 + 16 + c) % 64 for c in range(3))
    assert tuple(got[2].frames[0][0]) == (1.0, None, None) and tuple(got[4].frames[1][0]) == (None,) * 3
    assert tuple(got[None].frames[1][74]) == (None,) * 3 and tuple(got[None].frames[1][75]) == (2.0,) * 3 and got[-4].label is None


def smooth_by_hand(x, known):
    """One channel at a time: line over unknown values, then the textbook filter both ways."""
    t = np.arange(len(x))
    if not known.any():
        return np.zeros(len(x))
    ahead = kalman_matrix(np.interp(t, t[known], x[known]))
    return (ahead + kalman_matrix(ahead[::-1])[::-1]) / 2


def odd_clips():
    """Clips of joints: whole, gaps inside and at the ends, origin points, NaN, infinite and null coordinates, a joint never seen, one frame."""
    rng = np.random.default_rng(11)
    clips = [rng.normal(size=(n, 4, 3)).tolist() for n in (8, 8, 8, 3, 1)]
    clips[1][0][0] = clips[1][3][0] = clips[1][4][0] = clips[1][7][1] = None
    clips[1][2][2], clips[1][5][2] = [0.0] * 3, [1e-8, 0.0, None]
    clips[2][1][0][1], clips[2][2][1][0], clips[2][3][2][2] = math.nan, None, math.inf
    for frame in clips[2]:
        frame[3] = None
    return clips


def known_joints(clip):
    x = np.array([[[math.nan if v is None else v for v in (j or [None] * 3)] for j in f] for f in clip])
    known = np.isfinite(x)
    return x, known & (np.sqrt((np.where(known, x, 0) ** 2).sum(2)) >= 1e-6)[..., None]


def test_smoothed_joints_fill_what_is_missing(spark, monkeypatch):
    monkeypatch.setattr(points, "PIECE", 2)
    clips = odd_clips()
    rows = [(i, [[j and tuple(j) for j in f] for f in c]) for i, c in enumerate(clips)] + [(8, []), (9, None)]
    df = spark.createDataFrame(rows, "i long, c array<array<struct<x:double,y:double,z:double>>>").coalesce(1)
    got = {r.i: r.c for r in series.smooth_joints(df, "c").collect()}
    assert len(got) == 7 and got[8] == [] and got[9] is None
    for i, clip in enumerate(clips):
        x, known = known_joints(clip)
        want = [[smooth_by_hand(x[:, j, c], known[:, j, c]) for c in range(3)] for j in range(4)]
        assert np.allclose(np.array(got[i]).transpose(1, 2, 0), want, rtol=1e-9, atol=1e-12)


def test_joint_spectrum_fills_and_smooths_before_the_modes(spark):
    d = "/root/testdata/sf0.001"
    clips = views.point_clips(spark, d).select("vec_id", F.transform("frames", points.joints).alias("c"))
    got = {(r.vec_id, r.part): r for r in seqs.joint_spectrum(spark, d).collect()}
    assert len(got) == 3 * clips.count()
    for row in clips.filter("vec_id % 25 < 2").collect():
        x, known = known_joints(row.c)
        x = np.array([[smooth_by_hand(x[:, j, c], known[:, j, c]) for c in range(3)] for j in range(27)]).transpose(2, 0, 1)
        x = x - x[:, :1]
        x = x / np.linalg.norm(x[:, 1] - x[:, 2], axis=1).mean()
        for part, rows in {"upper": slice(0, 7), "left_hand": slice(7, 17), "right_hand": slice(17, 27)}.items():
            own, made = x[:, rows].reshape(8, -1).T, got[row.vec_id, part]
            h = np.concatenate([own[:, :7], own[:, 1:]])  # a third of 8 frames leaves two delays
            u, s, v = np.linalg.svd(h[:, :-1], full_matrices=False)
            values, inside = np.linalg.eig(u[:, :3].T @ h[:, 1:] @ v[:3].T / s[:3])
            order = np.lexsort((-np.abs(values), -np.abs(np.angle(values))))
            modes = (u[:, :3] @ inside[:, order])[: len(own)]
            start = np.abs(np.linalg.pinv(modes, rcond=1e-6) @ own[:, 0])
            course = start[:, None] * np.clip(np.abs(values[order]), 0.5, 1.5)[:, None] ** np.arange(8)
            angle = np.angle(values[order])
            want = np.stack([np.log1p(np.abs(values[order])), np.sin(angle), np.cos(angle), np.sqrt((course**2).mean(1))], 1)
            by_joint = np.abs(modes).reshape(-1, 3, 3).mean(1)
            assert np.allclose(made.spectrum, want.ravel(), atol=1e-6)
            assert np.allclose(made.modes, (by_joint / (by_joint.max(0) + 1e-6)).ravel(), atol=1e-6)
            change = np.diff(x[:, rows], axis=0, prepend=x[:1, rows])
            assert made.energy == pytest.approx(np.sqrt((change**2).mean()), rel=1e-9)


@pytest.mark.parametrize("name", ["augment_points", "point_layouts", "joint_spectrum", "normalize_position", "model_input", "hand_shapes"])
def test_point_queries_give_a_task_a_bounded_number_of_clips(spark, monkeypatch, name):
    monkeypatch.setattr(views, "POINT_TASK", 10, raising=False)
    vectors = views.embeddings(spark, "/root/testdata/sf0.001").count()
    made = getattr(seqs, name)(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.count("Relation [") == 1
    assert made.rdd.getNumPartitions() >= vectors / 10


def test_letter_counts_in_one_pass(spark):
    alphabet = views.ALPHABET
    texts = ["", None, "a b. A9", "\u00e9\u4e2d a\U0001f600z", "z" * 300, " \n\t."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    counted = df.filter("i >= 0").select("i", text.letter_counts(F.col("t"), alphabet).alias("c"))
    got = {r.i: r.c for r in counted.collect()}
    assert got == {i: [float((t or "").count(c)) for c in alphabet] for i, t in enumerate(texts)}
    assert spark.createDataFrame([], "t string").select(text.letter_counts(F.col("t"), alphabet)).count() == 0


@pytest.mark.parametrize("text", [None, "", "aab b. Z"])
def test_document_hashes_scan_a_text_once(spark, tmp_path, text):
    docs = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = views._document_hashes(spark, str(tmp_path))
    assert "replace(" not in made._jdf.queryExecution().optimizedPlan().toString()
    counts = [(text or "").count(c) for c in views.ALPHABET]
    bits = "".join("1" if n > sum(counts) / 64 else "0" for n in counts)
    assert made.first().h == np.uint64(int(bits, 2)).astype(np.int64)
