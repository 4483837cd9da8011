"""Mixing, fingerprints, language model, near duplicates and the pipeline against plain versions."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import SHARED, empty, labels, odd, odd_rows, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from glossloom.llm import cover_tree, fingerprints, language_model, mixing, near_duplicates
from glossloom.llm.common import table
from glossloom.llm.components import components

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Water level by clamping one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > epochs * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        s = over[0]
        out[s] = epochs * sizes[s]
        left -= out[s]
        free.remove(s)
    return out


def test_mix_of_awkward_rows(spark):
    rows = rows_of(mixing.mix_sources(odd(spark)))
    sizes = Counter()
    for _, t, _, s, _ in odd_rows():
        sizes[s] += len(words(t))
    want = targets(sizes)
    source = {i: s for i, _, _, s, _ in odd_rows()}
    assert len(rows) == len(odd_rows())
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
    assert rows == rows_of(mixing.mix_sources(odd(spark))) or sorted(map(str, rows)) == sorted(map(str, rows_of(mixing.mix_sources(odd(spark)))))
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [0.9, 0.2])
def test_mix_comes_near_the_targets(spark, hot):
    n = 4_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < hot * n, "s0").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    sums = mixing.mix_sources(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in sums)


def test_mixed_documents_repeat_rows_as_the_mix_says(spark):
    docs = odd(spark)
    taken = Counter()
    for r in rows_of(mixing.mix_sources(docs)):
        taken[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in rows_of(mixed):
        got[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


# fingerprints


def plain_likeness(a, b):
    a, b = Counter((a or "").encode().split()), Counter((b or "").encode().split())
    both = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in both) / max(1, sum(max(a[w], b[w]) for w in both))


def test_fingerprints_follow_the_generalised_jaccard_similarity(spark):
    texts = sorted(((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()), reverse=True)
    got = {r["doc_id"]: r for r in rows_of(fingerprints.edited_fingerprints(table(spark, SF, "documents")))}
    error, likeness = [], []
    for i, (k, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(text)
        likeness += [plain_likeness(text, edited), plain_likeness(text, following)]
        error += [got[k]["near_edited"] - likeness[-2], got[k]["near_next"] - likeness[-1]]
    expected = np.sqrt(np.mean([x * (1 - x) / fingerprints.SAMPLES for x in likeness]))
    assert abs(np.mean(error)) < 0.012 and np.sqrt(np.mean(np.square(error))) < 1.3 * expected


def test_fingerprints_of_awkward_rows(spark):
    rows = rows_of(fingerprints.edited_fingerprints(odd(spark), samples=8))
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((r[0] for r in odd_rows()), key=repr)
    text = {i: t or "" for i, t, *_ in odd_rows()}
    for r in rows:
        for s in rows:
            if text[r["doc_id"]].split() == text[s["doc_id"]].split():
                assert r["fingerprint"] == s["fingerprint"]
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["fingerprint"] == by[2]["fingerprint"] == by[4]["fingerprint"] == "" and by[3]["near_next"] == 1.0
    order = sorted((i for i in text if i is not None), reverse=True) + [None]
    for a, b in zip(order, order[1:] + order[:1]):
        half = len(text[a]) // 2
        assert by[a]["edited_sha256"] == hashlib.sha256((text[a][: len(text[a]) - half] + text[b][:half]).encode()).hexdigest()
    assert fingerprints.edited_fingerprints(empty(spark), samples=8).count() == 0
    one = rows_of(fingerprints.edited_fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), samples=8))
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_fingerprint_plan_has_no_python(spark):
    plan = fingerprints.edited_fingerprints(table(spark, SF, "documents"), samples=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# language model


def test_language_model_baseline_and_gain(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["doc_id"]: r for r in rows_of(language_model.scores(docs))}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    check_baseline(rows, texts)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def check_baseline(rows, texts):
    counts = Counter()
    for k, t in texts.items():
        if zlib.crc32(str("" if k is None else k).encode()) % 7 != 2:
            counts.update([*words(t), "end"])
    n, v = sum(counts.values()), len(counts)
    for k, t in texts.items():
        tokens = [*words(t), "end"]
        assert rows[k]["n_tokens"] == len(tokens) and rows[k]["n_known"] == sum(counts[w] > 0 for w in tokens) and rows[k]["train_tokens"] == n
        assert rows[k]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert rows[k]["score"] < 0


def test_language_model_of_awkward_rows(spark):
    rows = rows_of(language_model.scores(odd(spark)))
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((r[0] for r in odd_rows()), key=repr)
    unique = odd(spark).dropDuplicates(["doc_id"])
    check_baseline({r["doc_id"]: r for r in rows_of(language_model.scores(unique))}, {i: t for i, t, *_ in odd_rows()})
    assert language_model.scores(empty(spark)).count() == 0


def test_rare_tokens_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(language_model, "EXACT", 8)
    docs = table(spark, SF, "documents")
    check_baseline({r["doc_id"]: r for r in rows_of(language_model.scores(docs))}, {r["doc_id"]: r["text"] for r in docs.collect()})


def plain_scores(texts, exact):
    """Smoothed bigram scores with every bigram of the training texts, without a filter."""
    kept = [[*words(t), "end"] for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    counts, pairs = Counter(w for ws in kept for w in ws), Counter((a, b) for ws in kept for a, b in zip(["", *ws], ws))
    stands = lambda n: float(language_model.representative(language_model.level_of(n)))
    n, v, mass = sum(counts.values()), len(counts), language_model.MASS
    classes, held = Counter(math.floor(math.log2(c) * 16) for c in counts.values()), 0
    least = math.inf
    for k in sorted(classes, reverse=True):
        held += classes[k]
        if held > exact:
            break
        least = k
    frequent = {w for w, c in counts.items() if math.floor(math.log2(c) * 16) >= least}
    rare = (n - sum(counts[w] for w in frequent)) / max(1, v - len(frequent))

    def of(a, b):
        seen = stands(pairs[a, b])
        context = len(kept) if a == "" else counts[a] if a in frequent else stands(counts[a])
        count = counts[b] if b in frequent or not seen else rare
        return math.log10((seen + mass * (count + 1) / (n + v + 1)) / (max(context, seen) + mass))

    return {k: sum(of(a, b) for a, b in zip(["", *words(t)], [*words(t), "end"])) for k, t in texts.items()}


@pytest.mark.parametrize("bounds", [{}, {"EXACT": 8}, {"EXACT": 400, "SEGMENT_KEYS": 500, "GROUP_BYTES": 4_000}])
def test_all_bigrams_count_at_any_bound_of_the_broadcasts(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(language_model, name, value)
    docs = table(spark, SF, "documents")
    want = plain_scores({r["doc_id"]: r["text"] for r in docs.collect()}, language_model.EXACT)
    got = {r["doc_id"]: r["score"] for r in rows_of(language_model.scores(docs))}
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=2e-3)
    assert all(got[k] == pytest.approx(want[k], rel=2e-2) for k in want)


def test_texts_are_scored_once_however_many_segments(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {r["doc_id"]: r for r in rows_of(language_model.scores(docs))}
    tables, write = [], language_model.stored
    monkeypatch.setattr(language_model, "stored", lambda df, name="table", *a: tables.append(name) or write(df, name, *a))
    for name, value in {"SEGMENT_KEYS": 20_000, "GROUP_BYTES": 4_000, "BATCH_BYTES": 200_000}.items():
        monkeypatch.setattr(language_model, name, value, raising=False)
    got = {r["doc_id"]: r for r in rows_of(language_model.scores(docs))}
    assert tables.count("scored") == 1 and "numbered" not in tables
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert all(got[k][c] == r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens"))
        assert got[k]["base_score"] == pytest.approx(r["base_score"], rel=1e-9) and got[k]["score"] == pytest.approx(r["score"], rel=2e-2)


def test_tokens_of_the_language_model_are_words_and_ends():
    texts = ["", " a  B", "x" * 200 + " y", "\u00fcber Stra\u00dfe", "\t\n", "a " * 70_000 + "z" * 70_000 + " end", *(t or "" for _, t, *_ in odd_rows())]
    tokens, lengths = next(language_model._documents(texts))
    want = [[*words(t), None] for t in texts]
    assert list(lengths) == [len(w) for w in want]
    names = {}
    assert all(names.setdefault(w, h) == h for w, h in zip((w for ws in want for w in ws), tokens.tolist())) and len(set(names.values())) == len(names)


def test_fitted_segments_hold_the_bigrams_of_training_documents(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SEGMENT_KEYS", 4)
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "a b d"), (3, "e f")], "doc_id long, text string")
    model, _, built = language_model.fit(docs, F.col("doc_id") < 3)
    data = {r["segment"]: bytes(r["data"]) for r in built.collect()}
    tokens, lengths = next(language_model._documents(["a b a b c", "a b d", "e f"]))
    g, _, _ = language_model.bigrams(tokens, lengths, language_model._places(model.hashes, tokens))
    at = language_model.segment_of(g, model.segments)
    short = g & np.uint64((1 << 8 * language_model.KEY_BYTES) - 1)
    held = language_model.Filter(0, [data.get(s, bytes(8)) for s in range(model.segments)])
    assert model.tokens == 10 and model.texts == 2
    assert list(representative_of(held, short, at)) == [2, 3, 1, 3, 1, 1, 2, 3, 1, 1, 0, 0, 0]


def representative_of(held, keys, at):
    return language_model.representative(held.levels(keys, at)).astype(int)


def test_filter_reads_back_levels():
    rng = np.random.default_rng(2)
    keys, n = rng.integers(0, 2**62, 20_000), rng.geometric(0.3, 20_000)
    g, q = language_model.keyed(language_model.PAIR, keys), language_model.level_of(n)
    assert list(language_model.level_of(np.arange(9))) == [0, 1, 2, 3, 4, 4, 5, 5, 6] and language_model.representative(np.array([0, 1, 2, 3, 4]))[-1] == 4.5
    at = language_model.segment_of(g, 3)
    held = language_model.Filter(0, [language_model.segment_bytes(g[at == i], q[at == i]) for i in range(3)])
    got = held.levels(g, at)
    assert (got >= q).all() and (got == q).mean() > 0.97
    other = language_model.keyed(language_model.PAIR, rng.integers(0, 2**62, 20_000))
    assert (held.levels(other, language_model.segment_of(other, 3)) > 0).mean() < 0.02


# near duplicates


def plain_components(pairs, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, plain_components(links, ids)


def check_near(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(near_duplicates.near_duplicates(docs, **how))}
    sets, want = plain_near(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def family(rng, n, size, change, start):
    base = rng.integers(0, 5_000, size)
    out = []
    for i in range(n):
        w = base.copy()
        at = rng.integers(0, size, rng.integers(0, change + 1))
        w[at] = rng.integers(0, 5_000, len(at))
        out.append((start + i, " ".join(f"w{x}" for x in w)))
    return out


def test_near_duplicates_with_large_nodes(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = family(rng, 150, 200, 5, 0) + family(rng, 40, 60, 2, 1_000) + family(rng, 30, 12, 1, 2_000)
    rows += [(3_000 + i, passage + " " + " ".join(f"u{x}" for x in rng.integers(0, 9_000, 60))) for i in range(80)]
    check_near(spark, rows, small=16, deepest=2)
    check_near(spark, rows)


def test_near_duplicates_whose_only_partner_lies_in_another_chunk(spark):
    rng = np.random.default_rng(11)
    passages = [" ".join(f"p{i}x{j}" for j in range(40)) for i in range(24)]
    rows = [(i, " ".join(passages[j] for j in rng.choice(24, 6, replace=False))) for i in range(600)]
    rows += [(1_000 + i, rows[i][1] + " changed") for i in range(30)]
    check_near(spark, rows, small=16, deepest=1, recall=0.99)


def test_near_duplicates_of_awkward_rows(spark):
    rows = rows_of(near_duplicates.near_duplicates(odd(spark)))
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((r[0] for r in odd_rows()), key=repr)
    found = {r["doc_id"]: r for r in rows}
    assert found[7]["component_id"] == 6 == found[8]["component_id"] and found[14]["component_id"] == 13
    assert all(found[i]["component_id"] == i and found[i]["kept"] and found[i]["n_shingles"] == 0 for i in (2, 3, 4))
    assert found[None]["component_id"] is None and not found[None]["kept"]
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(300)] + [(1_000, x) for x in range(1_001, 1_200)] + [tuple(map(int, rng.integers(2_000, 2_400, 2))) for _ in range(250)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components(edges, sorted({v for e in edges if e[0] != e[1] for v in e}))
    assert got == {v: c for v, c in want.items()}


# vectors


def check_vectors(spark, rows, **how):
    got = {r["vec_id"]: r for r in rows_of(cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **how))}
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= 0.95]
    degree = Counter(x for e in links for x in e)
    want = plain_components(links, [i for i, _ in rows])
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (degree[i], want[i], want[i] == i) for i, _ in rows}


@pytest.mark.parametrize("block", [16, 4_096])
def test_vectors(spark, block):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 8))
    x[40:80] = x[:1] + 0.12 * rng.normal(size=(40, 8))
    x[80:100] = x[1:2]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] + [1.0] * 6), (204, [float("nan")] + [1.0] * 7), (205, [float("inf")] + [1.0] * 7), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, [float(3 * y) for y in x[0]])]
    check_vectors(spark, rows, block=block)


def test_components_in_rounds_and_at_once(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i - 1) for i in range(40)] + [(-5, -5)] + [tuple(map(int, rng.integers(2_000, 2_100, 2))) for _ in range(60)]
    real = [e for e in edges if e[0] != e[1]]
    want = plain_components(real, sorted({v for e in real for v in e}))
    for few in (0, 50_000):
        assert {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()} == want
        assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_common_elements_of_sets():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 6_000, n).astype(np.uint64)) for n in (1, 40, 900, 2_500, 2_500, 4_000)]
    got = near_duplicates._common(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(6) for j in range(6) if i != j)


def test_near_copies_partly_linked_are_not_branched_over_and_over(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = family(rng, 120, 150, 3, 0) + [(1_000 + i, t) for i, (_, t) in enumerate(family(rng, 60, 150, 60, 0))]
    base = rows[0][1].split()
    for i in range(60):
        w = list(base)
        for at in rng.choice(len(w), 8, replace=False):
            w[at] = f"x{rng.integers(0, 9_000)}"
        rows.append((2_000 + i, " ".join(w)))
    seen, real = Counter(), near_duplicates.stored

    def counted(df, name="table"):
        out = real(df, name)
        seen[name] += out.count()
        return out

    monkeypatch.setattr(near_duplicates, "stored", counted)
    check_near(spark, rows, small=32)
    assert sum(seen[x] for x in ("nodes", "apart_nodes", "grown")) <= 25 * len(rows), seen


def test_comparing_needs_one_byte_of_a_position(spark):
    rows = near_duplicates.sketched(spark.createDataFrame([(1, "a b c d e f"), (2, " ")], "doc_id long, text string"), "text", "doc_id", 5, 64).collect()
    assert len(rows[0]["bits"]) == 64 and rows[0]["bits"] == bytes(rows[0]["sketch"][::4]) and rows[1]["bits"] is None


def test_vectors_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, n long, v string"
    assert cover_tree.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = rows_of(cover_tree.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "a"), (None, [0.0, 1.0], 1, "b")], schema)))
    assert sorted((r["n_links"] for r in got)) == [0, 1, 1]


# pipeline


def test_pipeline_keeps_clean_documents_and_all_tokens(spark, tmp_path):
    docs = table(spark, SF, "documents")
    first = corpus_pipeline.by_language(spark, docs, SF)
    assert first.columns == docs.columns and first.count() >= 0.99 * docs.filter("text is not null").count()
    alone = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    _, want = plain_near([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = [r["doc_id"] for r in alone.collect()]
    assert alone.columns == docs.columns and Counter(want[i] for i in kept) == Counter(set(want.values()))
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            out.count()
            if name != "packing":
                assert out.columns == docs.columns
    left = [r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sum(i in (6, 7, 8) for i in left) == 1 and left.count(None) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mix", "packing"]


def test_pipeline_does_not_shuffle_texts_to_drop_few(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.without_near_duplicates(spark, table(spark, SF, "documents").limit(60), SF)
        out.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and out.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
