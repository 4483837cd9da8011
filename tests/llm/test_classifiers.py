"""Classifiers: held-out accuracy on the given tables, and awkward rows."""

import numpy as np
import pytest
from cases import empty, labels, odd, odd_rows, rows_of
from pyspark.sql import functions as F

from glossloom.llm import language, quality, toxicity
from glossloom.llm.common import table
from glossloom.llm.fit import labelled_sample
from glossloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def held(spark, name, label):
    rows = QUERIES[name](spark, SF).filter("held_out").join(table(spark, SF, "labels"), "doc_id").filter(F.col(label).isNotNull())
    p = rows.toPandas()
    return p, p[label].to_numpy() == 1


def test_toxicity_on_documents_held_out(spark):
    p, y = held(spark, "op3_toxicity", "toxic")
    assert auc(p["score"].to_numpy(), y) > 0.85
    assert (p["predicted"].to_numpy() == y).mean() > 0.9
    assert ((p["score"] >= 0.5) == (p["predicted"] == 1)).all() and p["score"].between(0, 1).all()


def test_quality_on_documents_held_out(spark):
    p, y = held(spark, "op6_quality", "quality")
    assert auc(p["score"].to_numpy(), y) > 0.98
    assert (p["predicted"].to_numpy() == y).mean() > 0.97
    assert ((p["score"] >= 0.7) == (p["predicted"] == 1)).all()


def test_language_on_documents_held_out(spark):
    p = QUERIES["op9_language"](spark, SF).filter("held_out").join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (p["lang_pred"] == p["lang"]).mean() > 0.97


@pytest.mark.parametrize("score", [lambda s, d: toxicity.toxicity_scores(d, labels(s)), lambda s, d: quality.quality_scores(d, labels(s)), lambda s, d: language.languages(d)])
def test_awkward_rows(spark, score):
    rows = rows_of(score(spark, odd(spark)))
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((r[0] for r in odd_rows()), key=repr)
    assert all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 6]
    assert len(same) == 3 and len(set(same)) == 1
    assert score(spark, empty(spark)).count() == 0


def test_no_labels(spark):
    none = labels(spark, [(1, None, None)])
    assert toxicity.toxicity_scores(odd(spark), none).filter("score between 0 and 1").count() == len(odd_rows())
    assert quality.quality_scores(odd(spark), none).filter("score between 0 and 1").count() == len(odd_rows())


def test_unknown_language(spark):
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows_of(language.languages(odd(spark)))}
    assert all(found[i] == ("und", 0.0) for i in (2, 3, 4, 12)) and found[1][0] != "und"
    unlearned = rows_of(language.languages(odd(spark).withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in unlearned} == {"und"}


def plain_marginals(scores, transitions, start):
    """Sum over all label paths of one chain."""
    import itertools

    n, k = scores.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(start[path[0]] + sum(scores[i, c] for i, c in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        for i, c in enumerate(path):
            out[i, c] += w
    return out / out.sum(1, keepdims=True)


def test_forward_backward_equals_the_sum_over_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 1, 3])
    scores, transitions, start = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, _, _ = language.marginals(scores, lengths, transitions, start)
    for i, n in enumerate(lengths):
        assert np.allclose(got[i, :n], plain_marginals(scores[i, :n], transitions, start))


def test_words_of_mixed_text_get_their_own_languages(spark):
    model = language.fit(table(spark, SF, "documents"))
    both = {r["lang"]: r["t"] for r in table(spark, SF, "documents").filter("n_chars between 300 and 900").groupBy("lang").agg(F.min("text").alias("t")).collect()}
    en, de = both["en"].lower().split()[:30], both["de"].lower().split()[:30]
    names = [model.languages[i] for i in language.label_words(en + de, model).argmax(1)]
    assert np.mean([a == b for a, b in zip(names, ["en"] * len(en) + ["de"] * len(de))]) > 0.85


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(0)
    rows = [(" ".join(rng.choice(["alpha", "beta!!", "gamma###", "d"], 30, p=p)), int(y)) for y in (0, 1) for p in [([0.4, 0.1, 0.1, 0.4], [0.1, 0.4, 0.4, 0.1])[y]] for _ in range(60)]
    rules = quality.train(rows)
    df = spark.createDataFrame([(t,) for t, _ in rows], "text string")
    got = [r["s"] for r in df.select(quality.compiled(rules, quality.text_statistics(F.col("text"))).alias("s")).collect()]
    for (text, _), s in zip(rows, got):
        stats = dict(zip(quality.STATISTICS, quality.statistics(text)))
        total = rules.intercept + sum(w for w, c in rules.rules if all(stats[n] <= v if sign == "<=" else stats[n] > v for n, sign, v in c))
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-9
    assert rules.rules and auc(np.array(got), np.array([y == 1 for _, y in rows])) > 0.9


@pytest.mark.parametrize("n", [0, 1, 2, 4, 20, 39, 60, 79, 100])
def test_quality_of_small_samples(n):
    rows = [("good words here. " * 5 if i % 2 else "bad ### $$$ ", i % 2) for i in range(n)]
    rules = quality.train(rows)
    assert np.isfinite(rules.intercept) and (n < 20 or rules.rules)


def test_sample_takes_exactly_as_many_rows_as_wanted(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 3 else 60_000)) for i in range(90)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(1, 0), (4, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, marks, "toxic", F.col("doc_id") >= 0, {0: 7, 1: 200})
    assert sum(y == 0 for _, y in rows) == 7 and sum(y == 1 for _, y in rows) == 31 and all(len(t) == 10 for t, _ in rows)
