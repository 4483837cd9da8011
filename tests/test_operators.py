"""Operators against brute force on small fixtures, with one hot group holding most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossloom.functions import hashing
from glossloom.operators import compare, dedup, guarded, holdout, joins, ranking, score, series, sessions, splits


def skewed(spark, n=3000):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"g{rnd.randrange(50)}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string")


def ranks_of(rows, key):
    groups = defaultdict(list)
    for i, g in rows:
        groups[g].append(i)
    return {i: r for g, ids in groups.items() for r, i in enumerate(sorted(ids, key=key), 1)}


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_rank(spark, digits):
    import hashlib

    rows, df = skewed(spark)
    df = df.withColumn("h", hashing.seeded_order(5, F.col("id")))
    got = {r.id: (r["rank"], r.n) for r in ranking.hash_rank(df, ["g"], "h", total="n", digits=digits).collect()}
    want = ranks_of(rows, lambda i: hashlib.md5(f"5|{i}".encode()).hexdigest())
    sizes = defaultdict(int)
    for _, g in rows:
        sizes[g] += 1
    assert got == {i: (want[i], sizes[g]) for i, g in rows}


def test_range_and_time_rank(spark):
    rows, df = skewed(spark)
    df = df.withColumn("ts", F.timestamp_seconds(F.col("id") * 37))
    want = ranks_of(rows, lambda i: i)
    assert {r.id: r["rank"] for r in ranking.range_rank(df, ["g"], [F.col("id")]).collect()} == want
    got = ranking.time_rank(df, ["g"], "ts", ["id"], rows_per_bucket=100)
    assert {r.id: r.pos for r in got.collect()} == want


def test_cap_and_take(spark):
    rows, df = skewed(spark)
    df = df.withColumn("h", hashing.seeded_order(1, F.col("id")))
    kept = ranking.cap_per_group(df, ["g"], "h", 7, ["id"]).groupBy("g").count().collect()
    sizes = df.groupBy("g").count().collect()
    assert {r.g: r["count"] for r in kept} == {r.g: min(7, r["count"]) for r in sizes}
    first = {r.g: r.id for r in ranking.take_first(df, ["g"], ["id"]).collect()}
    last = {r.g: r.id for r in ranking.take_last(df, ["g"], ["id"]).collect()}
    assert first == {g: min(i for i, x in rows if x == g) for g in first}
    assert last == {g: max(i for i, x in rows if x == g) for g in last}


@pytest.mark.parametrize("width", [50, 1_000_000])
def test_gap_sessions_and_asof(spark, width):
    rnd = random.Random(1)
    nums = sorted(rnd.sample(range(5000), 300))
    df = spark.createDataFrame([("a", n) for n in nums] + [("a", nums[0])], "g string, n long")
    got = {r.n: r.session_start for r in sessions.gap_sessions(df, ["g"], "n", 20, width).collect()}
    want, start, prev = {}, None, None
    for n in nums:
        start = n if prev is None or n - prev > 20 else start
        want[n], prev = start, n
    assert got == want
    starts = sorted(rnd.sample(range(5000), 20))
    right = spark.createDataFrame([("a", s) for s in starts], "g string, s long")
    got = {r.n: r.s for r in sessions.asof_backward(df, right, ["g"], "n", "s", width).collect()}
    assert got == {n: max((s for s in starts if s <= n), default=None) for n in nums}


def test_session_gap_is_strict(spark):
    df = spark.createDataFrame([(0,), (200,), (401,)], "n long")
    got = {r.n: r.session_start for r in sessions.gap_sessions(df, [], "n").collect()}
    assert got == {0: 0, 200: 0, 401: 401}


def test_fill_sessions(spark):
    rows = [("include", "MVI_1000", ""), ("include", "MVI_1013", ""), ("include", "MVI_3000", "given"), ("other", "MVI_1", "")]
    df = spark.createDataFrame(rows, "source string, rel string, session string")
    from glossloom.functions.text import clip_counter

    out = sessions.fill_sessions(df, "include", clip_counter(F.col("rel")))
    assert sorted((r.source, r.rel, r.session) for r in out.collect()) == [
        ("include", "MVI_1000", "include_s1000"), ("include", "MVI_1013", "include_s1000"),
        ("include", "MVI_3000", "given"), ("other", "MVI_1", ""),
    ]


def near_fixture(seed=1):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) - 2**63 for _ in range(20)]
    rows = []
    for i in range(300):
        h = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
            h ^= 1 << rnd.randrange(63)
        rows.append((i, f"g{i % 2}", h))
    return rows


def bits(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


@pytest.mark.parametrize("hot", [1, 2000])
def test_near_duplicates(spark, hot):
    rows = near_fixture()
    df = spark.createDataFrame(rows, "o long, g string, h long")
    got = {r.o: r.kept_by for r in dedup.greedy_near_duplicates(df, ["g"], "h", "o", 3, hot).collect()}
    kept, want = [], {}
    for o, g, h in rows:
        owner = next((ko for ko, kg, kh in kept if kg == g and bits(kh, h) <= 3), None)
        want[o] = o if owner is None else owner
        if owner is None:
            kept.append((o, g, h))
    assert got == want
    pairs = dedup.near_pairs(df.select("g", "h").distinct(), ["g"], "h", 3, hot).collect()
    names = {(g, h) for _, g, h in rows}
    assert {(p.g, p.h_a, p.h_b) for p in pairs} == {(g, a, b) for g, a in names for k, b in names if g == k and a < b and bits(a, b) <= 3}


def holdout_loop(clips, seed, salt, limits, need_help):
    import hashlib

    per = defaultdict(lambda: defaultdict(int))
    for ident, word in clips:
        per[ident][word] += 1
    have = dict.fromkeys(limits, 0)
    taken = set()
    for ident in sorted(per, key=lambda i: hashlib.md5(f"{seed}|{salt}|{i}".encode()).hexdigest()):
        items = per[ident]
        useful = any(have[w] < limits[w][0] for w in (items if need_help else have))
        if useful and all(have[w] + n <= limits[w][1] for w, n in items.items()):
            taken.add(ident)
            for w, n in items.items():
                have[w] += n
    return taken


@pytest.mark.parametrize("chunk", [3, 5000])
def test_holdout_equals_loop(spark, chunk):
    rnd = random.Random(4)
    clips = [(f"id{min(rnd.randrange(60), rnd.randrange(60))}", f"w{rnd.randrange(6)}") for _ in range(400)]
    df = spark.createDataFrame(clips, "identity string, word string")
    total = defaultdict(int)
    for _, w in clips:
        total[w] += 1
    limits = {}
    for w, n in total.items():
        t = min(max(2, round(0.25 * n)), 20)
        limits[w] = (t, max(t, n // 2))
    got = defaultdict(set)
    for r in holdout.fixed_test(df, [0, 1], chunk).collect():
        got[r.seed].add(r.identity)
    assert got == {s: holdout_loop(clips, s, "test", limits, True) for s in (0, 1)}
    lock = {r.identity for r in holdout.lock_identities(df, 42, chunk=chunk).collect()}
    limits = {w: (15, n - min(8, max(0, n - 1))) for w, n in total.items()}
    assert lock == holdout_loop(clips, 42, "lock", limits, False)


def protocol_clips(spark):
    rows = [(f"{w}_{s}_{c}", w, "isl500", f"signer:User{s}") for w in ["eat", "go", "book", "cat"] for s in range(12) for c in range(2)]
    return spark.createDataFrame(rows, "key string, word string, source string, identity string")


def test_nested_and_stable_splits(spark):
    clips = protocol_clips(spark)
    test_keys, previous = None, set()
    for k in (1, 2, 4):
        split = splits.make_split(clips, "scarce", k).collect()
        test = {r.key for r in split if r.side == "test"}
        train = {r.key for r in split if r.side == "train" and r.word in ("eat", "go")}
        ids = lambda side: {r.identity for r in split if r.side == side}
        assert not ids("train") & ids("test")
        assert test_keys in (None, test) and previous <= train and len(train) == 2 * k
        test_keys, previous = test, train
    uniform = splits.make_split(clips, "uniform", 4).collect()
    assert {r.key for r in uniform if r.side == "test"} == test_keys


def test_vocabulary_keeps_targets(spark):
    split = splits.make_split(protocol_clips(spark), "scarce", 2, n_words=3).select("word").distinct()
    words = {r.word for r in split.collect()}
    assert {"eat", "go"} <= words and len(words) == 3


def test_pool_first_is_prefix_of_pool_order(spark):
    clips = protocol_clips(spark)
    full = {(r.key, r.pool_rank) for r in splits.pool_order(clips, 3).filter("pool_rank <= 15").collect()}
    assert {(r.key, r.pool_rank) for r in splits.pool_first(clips, 3, 15).collect()} == full


def test_fewshot_sizes_and_fallback(spark):
    rows = [(f"{w}{s}", w, f"signer:User{s}") for w in [f"w{i}" for i in range(8)] for s in range(7)] + [("solo", "solo", "clip:solo")]
    clips = spark.createDataFrame(rows, "key string, word string, identity string")
    split = splits.fewshot_split(clips, 5, 15, 1, draw_seeds=[42, 1051])
    per = split.groupBy("draw", "word").pivot("side", ["train", "val", "test"]).count().collect()
    assert {(r.train, r.val, r.test) for r in per if r.word != "solo"} == {(5, 1, 1)}
    tests = split.filter("side = 'test'").groupBy("draw").agg(F.sort_array(F.collect_list("key")).alias("k")).collect()
    assert tests[0].k == tests[1].k
    audit = splits.fewshot_audit(split, clips, 5, 1, 15).filter("word = 'w0'").first()
    assert "wanted 15" in audit.warnings
    assert not splits.meets_spec(audit_df := splits.fewshot_audit(split, clips, 5, 1, 15)).first().meets_spec and audit_df.count() == 18


def test_match_levels_and_alignment(spark):
    targets = spark.createDataFrame([("thank you", 0), ("hello", 1)], "word string, pos int")
    rows = spark.createDataFrame([("hello",), ("thankyou",), ("bye",)], "l string")
    got = {r.l: (r.target, r["match"]) for r in joins.match_targets(rows, F.col("l"), targets).collect()}
    assert got == {"hello": ("hello", "exact"), "thankyou": ("thank you", "normalized"), "bye": (None, "no_match")}
    asked = spark.createDataFrame([("thank_you", 0), ("HELLO", 1), ("Thank You", 2), ("x", 3)], "name string, pos int")
    out = joins.align_words(asked, targets).collect()
    assert sorted((r.word, r.name) for r in out if r.found) == [("hello", "HELLO"), ("thank you", "thank_you")]
    assert [r.name for r in out if not r.found] == ["x"]


def test_stem_match(spark):
    wanted = spark.createDataFrame([("abc_1",), ("abc_2",), ("zz",), ("none",)], "uid string")
    files = spark.createDataFrame([("d/abc_1.mp4",), ("d/abc.mp4",), ("d/zz9.mp4",)], "path string")
    got = {r.uid: (r.path, r["rank"]) for r in joins.stem_match(wanted, files).collect()}
    assert got == {"abc_1": ("d/abc_1.mp4", 0), "abc_2": ("d/abc.mp4", 1), "zz": ("d/zz9.mp4", 2)}


def test_expand_grid(spark):
    grid = joins.expand_grid(spark, {"k": [1, 2], "seed": [0, 1, 2]}, [{"p": "a"}, {"p": "b", "k": 9}], {"p": "z", "m": "x"})
    rows = grid.orderBy("pos").collect()
    assert len(rows) == 12 and [r.pos for r in rows] == list(range(12))
    assert {(r.p, r.m) for r in rows} == {("a", "x"), ("b", "x")} and {r.k for r in rows} == {1, 2}


def test_prototype_blocks_agree(spark):
    rnd = random.Random(2)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(6)]
    train = spark.createDataFrame([(i % 9, vec()) for i in range(90)], "label int, v array<double>")
    items = spark.createDataFrame([(i, vec()) for i in range(40)], "id int, v array<double>").withColumn("one", F.lit(1))
    protos = score.prototypes(train.withColumn("one", F.lit(1)), ["one"], "label", "v")
    runs = [
        {r.id: r.ranked for r in score.nearest_prototype(items, protos, ["one"], "label", "v", 9, block=b).collect()} for b in (2, 2000)
    ]
    assert runs[0] == runs[1] and all(len(r) == 5 for r in runs[0].values())


def test_metrics_by_hand(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (2, 3)]
    preds = spark.createDataFrame(rows, "y int, pred int").withColumn("run", F.lit("r"))
    f1 = {0: 2 / 3, 1: 2 * 2 / (4 + 2 + 0), 2: 0.0, 3: 0.0}
    present = score.macro_f1(preds, ["run"]).first().macro_f1
    union = score.macro_f1(preds, ["run"], "union").first().macro_f1
    assert present == pytest.approx(sum(f1[c] for c in (0, 1, 2)) / 3) and union == pytest.approx(sum(f1.values()) / 4)
    m = score.run_metrics(preds, ["run"], lambda c: c == 0).first()
    assert (m.top1, m.target_top1, m.target_to_rich_rate, m.rich_to_target_rate) == (0.5, 0.5, 0.5, 0.0)
    per = {r.y: (r.correct, r.errors, r.confused_with) for r in score.per_class_scores(preds, ["run"]).collect()}
    assert per == {0: (1, 1, 1), 1: (2, 0, None), 2: (0, 2, 1)}


def test_single_value_deviation(spark):
    runs = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("b", 1, 3.0), ("b", 2, float("nan"))], "m string, seed int, v double")
    rows = {r.m: r for r in compare.summarise(runs, ["m"], ["v"]).collect()}
    assert rows["a"].v_std is None and rows["b"].v_mean == 2.0
    zero = {r.m: r.v_std for r in compare.summarise(runs, ["m"], ["v"], single_std_zero=True).collect()}
    assert zero["a"] == 0.0


def test_clips_are_bounded_and_whole(spark):
    rows = [("u", i) for i in range(1000)] + [("w", 5)]
    df = spark.createDataFrame(rows, "u string, i long").withColumn("ts", F.timestamp_seconds("i"))
    cut = series.cut_clips(df, ["u"], "ts", ["i"], 64)
    sizes = cut.groupBy("u", "clip").count().collect()
    assert max(r["count"] for r in sizes) == 64 and sum(r["count"] for r in sizes) == 1001
    order = cut.filter("u = 'u'").orderBy("clip", "frame").select("i").collect()
    assert [r.i for r in order] == list(range(1000))


def test_fingerprint_has_one_form_at_every_size(spark):
    import hashlib

    def plain(keys):
        digests = [hashlib.sha1(k.encode()).hexdigest() for k in keys]
        sums = [sum(int(h[a : a + 15], 16) for h in digests) for a in (0, 15)]
        return hashlib.sha1(f"{len(keys)}|{sums[0]}|{sums[1]}".encode()).hexdigest()[:12]

    for keys in (["b", "a", "c"], [f"k{i}" for i in range(150_000)]):
        df = spark.createDataFrame([("s", k) for k in keys], "g string, key string")
        for rows in (df, df.repartition(7)):
            assert hashing.key_fingerprint(rows, ["g"], "key").first().fingerprint == plain(keys)


def test_modalities_are_named_once():
    from glossloom.operators import features

    known = features.standard()
    known.register("own", lambda v: v)
    with pytest.raises(ValueError, match="taken"):
        known.register("own", lambda v: v)
    with pytest.raises(ValueError, match="unknown modality"):
        known.feature("none", None)
    assert known.names() == ["energy", "own", "resampled", "value"]


def test_split_guards(spark):
    clips = protocol_clips(spark)
    with pytest.raises(ValueError, match="unknown protocol"):
        splits.make_split(clips, "other")
    with pytest.raises(ValueError, match="sources"):
        splits.make_split(clips, "cross_source")


def test_deduplicate_as_one_pass(spark):
    """A near copy that was dropped still owns its content; nulls and groups as stated."""
    rows = [
        (1, "a", "w", "s1", 0b0000), (2, "b", "w", "s1", 0b0011), (3, "b", "w", "s2", 0b0011), (4, "c", "w", "s2", 0b0111),
        (5, "d", "w", "s1", 0b111100), (6, "e", "w", None, 0b0), (7, "f", "w", None, 0b1), (8, None, "w", "s3", 0b0), (9, None, "w", "s4", 0b0),
        (10, "g", "w", "s1", None), (11, "a", "v", "s9", None), (12, "h", "w", "s1", 0b11100000), (13, "i", "w", "s1", 0b10100),
    ]
    owner, kept, want = {}, [], {}
    for o, text, word, signer, h in rows:
        if text is not None and text in owner:
            want[o] = ("exact_sha_duplicate", owner[text], "sha256")
            continue
        if text is not None:
            owner[text] = o
        hit = next((k for k, g, x in kept if g == (word, signer) and None not in (h, x) and (h ^ x).bit_count() <= 3), None)
        want[o] = ("near_phash_duplicate", hit, "phash<=3 same signer") if hit else ("kept", None, None)
        if not hit:
            kept.append((o, (word, signer), h))
    df = spark.createDataFrame(rows, "o long, text string, word string, signer string, h long")
    got = {r["o"]: (r["status"], r["kept"], r["reason"]) for r in dedup.deduplicate(df, F.col("text"), ["word", "signer"], "h", "o", "o").collect()}
    assert got == want
    assert {s for s, _, _ in want.values()} == {"kept", "exact_sha_duplicate", "near_phash_duplicate"}


def test_guarded_step_keeps_every_row_once(spark):
    """Raised errors, wrong types, nulls and repeats; an empty table gives two empty ones."""
    rows = [(f"p{i}", i % 7 if i % 11 else None) for i in range(500)] + [(None, 3), ("p1", 1)]
    df = spark.createDataFrame(rows, "path string, v int").repartition(4)

    def step(row):
        if row["v"] == 5:
            return {"inverse": "none"}
        return {"inverse": 1 / row["v"], "error": "ignored"}

    done, failed = guarded.guarded(df, step, "inverse double")
    got = sorted(((r["path"], r["inverse"]) for r in done.collect()), key=repr)
    assert got == sorted(((p, 1 / v) for p, v in rows if v and v != 5), key=repr)
    errors = sorted((r["path"], r["error"].split(":")[0]) for r in failed.collect())
    kind = lambda v: "TypeError" if v is None else "ZeroDivisionError"
    wrong = {p for p, v in rows if v == 5}
    assert [e for e in errors if e[0] not in wrong] == sorted((p, kind(v)) for p, v in rows if not v)
    assert [p for p, _ in errors if p in wrong] == sorted(wrong)
    assert [x.count() for x in guarded.guarded(df.limit(0), step, "inverse double")] == [0, 0]


def test_a_capped_group_is_cut_in_three_steps(spark):
    rows = [(g, f"{(i * 7919) % 65536:04x}{i % 3}", i) for g in ("a", "b") for i in range(2000 if g == "a" else 2)]
    capped = ranking.cap_per_group(spark.createDataFrame(rows, "g string, h string, i long"), ["g"], "h", 5, ["i"])
    assert sorted(map(tuple, capped.collect())) == sorted(r for g in "ab" for r in sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2]))[:5])
    assert capped._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 3


def test_a_holdout_gathers_no_seed_in_one_task(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(holdout, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.localCheckpoint())
    clips = spark.createDataFrame([(f"k{i}", "ab"[i % 2], f"id{i}") for i in range(60)], "key string, word string, identity string")
    assert holdout.lock_identities(clips, 1).count()
    visit = next(p for p in plans if "LeftSemi" in p)
    assert all("broadcast" in line for line in visit.splitlines() if "Join LeftSemi" in line or "Join Inner" in line)
