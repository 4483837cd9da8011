"""Queries on prototype predictions: metrics, paired tests, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions import text
from glossloom.functions.stats import mcnemar_p, wilson
from glossloom.operators import compare, joins, resample, score
from glossloom.operators.ranking import take_first
from glossloom.plans import views
from glossloom.plans.registry import query
from glossloom.plans.views import SEEDS, SHOTS, TARGET_LABELS, predictions, table, with_views

RUN = ["tag", "k", "seed", "model"]


def is_target(c):
    return c.isin(*TARGET_LABELS)


def _rounded(df, *cols, digits=9):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


@query("prototype_scores", with_views("preds", body="""
    SELECT tag, k, seed, model, key, y, pred, ranked[5] AS fifth FROM preds"""))
def prototype_scores(spark, d):
    return predictions(spark, d).select(*RUN, "key", "y", "pred", F.get("ranked", F.lit(4)).alias("fifth"))


_WILSON = "((n_ok / n + 3.8416 / (2 * n)) {op} 1.96 * sqrt(n_ok / n * (1 - n_ok / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"


@query("run_metrics", with_views("preds", body="""
    , m AS (SELECT tag, k, seed, model, count(*) AS n, count(*) FILTER (y < 3) AS n_target, count(*) FILTER (y = pred) AS n_ok,
      avg(CAST(y = pred AS INT)) AS top1, avg(CAST(y = pred AS INT)) FILTER (y < 3) AS tt, avg(CAST(y = pred AS INT)) FILTER (y >= 3) AS rt,
      avg(CAST(pred >= 3 AS INT)) FILTER (y < 3) AS tr, avg(CAST(pred < 3 AS INT)) FILTER (y >= 3) AS rr,
      avg(CAST(list_contains(ranked[1:5], y) AS INT)) AS t5, avg(CAST(list_contains(ranked[1:5], y) AS INT)) FILTER (y < 3) AS tt5
      FROM preds GROUP BY ALL)
    SELECT tag, k, seed, model, n AS n_test, n_target AS n_test_target, n_ok, round(top1, 9) AS top1, round(tt, 9) AS target_top1,
      round(rt, 9) AS rich_top1, round(tr, 9) AS target_to_rich_rate, round(rr, 9) AS rich_to_target_rate, round(t5, 9) AS top5,
      round(tt5, 9) AS target_top5, round(""" + _WILSON.format(op="-") + ", 9) AS top1_low, round(" + _WILSON.format(op="+") + """, 9) AS top1_high FROM m"""))
def run_metrics(spark, d):
    out = score.run_metrics(predictions(spark, d), RUN, is_target, "ranked")
    return _rounded(out, *[c for c in out.columns if c not in RUN and not c.startswith("n_")])


_CLASSES = """, cm AS (SELECT tag, k, seed, model, y, pred, count(*) AS n FROM preds GROUP BY ALL),
    cc AS (SELECT tag, k, seed, model, y AS c, CASE WHEN y = pred THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN y <> pred THEN n ELSE 0 END AS fn FROM cm
      UNION ALL SELECT tag, k, seed, model, pred, 0, n, 0 FROM cm WHERE y <> pred),
    cs AS (SELECT tag, k, seed, model, c, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cc GROUP BY ALL)
    SELECT tag, k, seed, model, round(avg(2.0 * tp / (2.0 * tp + fp + fn)), 9) AS macro_f1, count(*) AS n_classes FROM cs"""


@query("macro_f1_present", with_views("preds", body=_CLASSES + " WHERE tp + fn > 0 GROUP BY ALL"))
def macro_f1_present(spark, d):
    return _rounded(score.macro_f1(predictions(spark, d), RUN), "macro_f1")


@query("macro_f1_union", with_views("preds", body=_CLASSES + " GROUP BY ALL"))
def macro_f1_union(spark, d):
    return _rounded(score.macro_f1(predictions(spark, d), RUN, "union"), "macro_f1")


@query("macro_accuracy", with_views("preds", body="""
    SELECT tag, k, seed, model, round(avg(a), 9) AS macro_acc FROM (
      SELECT tag, k, seed, model, y, avg(CAST(y = pred AS INT)) AS a FROM preds GROUP BY ALL) GROUP BY ALL"""))
def macro_accuracy(spark, d):
    return _rounded(score.macro_accuracy(predictions(spark, d), RUN), "macro_acc")


@query("per_class_scores", with_views("preds", body="""
    , c AS (SELECT tag, k, seed, model, y, count(*) AS n, count(*) FILTER (y = pred) AS n_ok FROM preds GROUP BY ALL),
    w AS (SELECT tag, k, seed, model, y, arg_max(pred, m * 1000 - pred) AS confused_with FROM (
      SELECT tag, k, seed, model, y, pred, count(*) AS m FROM preds WHERE y <> pred GROUP BY ALL) GROUP BY ALL)
    SELECT c.tag, c.k, c.seed, c.model, c.y, n, n_ok AS correct, n - n_ok AS errors, round(n_ok / n, 9) AS acc,
      round(greatest(0, """ + _WILSON.format(op="-") + "), 9) AS low, round(least(1, " + _WILSON.format(op="+") + """), 9) AS high, confused_with
    FROM c LEFT JOIN w USING (tag, k, seed, model, y)"""))
def per_class_scores(spark, d):
    return _rounded(score.per_class_scores(predictions(spark, d), RUN), "acc", "low", "high")


@query("per_word_top1", with_views("preds", body="""
    SELECT tag, k, model, y, round(avg(a), 9) AS mean_top1, count(*) AS n_seeds FROM (
      SELECT tag, k, seed, model, y, avg(CAST(y = pred AS INT)) AS a FROM preds GROUP BY ALL) GROUP BY ALL"""))
def per_word_top1(spark, d):
    maps = score.per_word_top1(predictions(spark, d), RUN)
    rows = maps.select("tag", "k", "model", F.explode("per_word_top1").alias("y", "a"))
    out = rows.groupBy("tag", "k", "model", F.col("y").cast("int").alias("y")).agg(
        F.avg("a").alias("mean_top1"), F.count(F.lit(1)).alias("n_seeds")
    )
    return _rounded(out, "mean_top1")


@query("class_weights", with_views("emb", body="""
    , c AS (SELECT l AS label, greatest(count(label), 1) AS n FROM (SELECT unnest(range((SELECT max(label) + 3 FROM emb))) AS l) LEFT JOIN emb ON l = label GROUP BY l)
    SELECT label, round(1.0 / n / sum(1.0 / n) OVER () * count(*) OVER (), 9) AS weight FROM c"""))
def class_weights(spark, d):
    emb = table(spark, d, "embeddings", "label")
    labels = emb.agg(F.max("label").alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m") + 2)).alias("label"))
    return _rounded(score.class_weights(emb, labels, "label"), "weight")


_PAIRED = """, ok AS (SELECT tag, k, seed, model, key, y, y = pred AS ok FROM preds),
    pr AS (SELECT b.tag, b.k, b.model, b.y, a.ok AS a_ok, b.ok AS b_ok FROM ok a JOIN ok b USING (tag, k, seed, key) WHERE a.model = 'dim64' AND b.model <> 'dim64'),
    ct AS (SELECT tag, k, model, subset, count(*) FILTER (a_ok AND NOT b_ok) AS b, count(*) FILTER (NOT a_ok AND b_ok) AS c, count(*) AS n
      FROM (SELECT *, 'all' AS subset FROM pr UNION ALL SELECT *, 'target' FROM pr WHERE y < 3) GROUP BY ALL)"""
_P = """CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least({b}, {c}) + 1),
    lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2))))) END"""


@query("paired_tests", with_views("preds", body=_PAIRED + f"""
    SELECT tag, k, model, subset, b, c, n, round((c - b) / n, 9) AS delta, round({_P.format(b='b', c='c')}, 8) AS p FROM ct"""))
def paired_tests(spark, d):
    counts = compare.paired_summary(joins.paired_runs(predictions(spark, d), "dim64"), ["tag", "k", "model"], is_target, 200)
    return _rounded(_rounded(counts.drop("lo", "hi"), "delta"), "p", digits=8)


def _drawn_sql(by: list[str], key: list[str], n_boot: int, seed: int = 0) -> str:
    """CTE dr: the cells of the view `cells` with their weight w in every resample."""
    salt = f"'{seed}|' || " + " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in [*by, *key, "r"])
    unit = lambda more="": f"(('0x' || md5({salt}{more})[1:12])::BIGINT / 281474976710656.0)"
    u1, u2 = (unit(f" || '|{u}'") for u in ("u1", "u2"))
    return f"""
    pk AS (SELECT n, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS cdf FROM (
      SELECT n, unnest(range(CAST(n + ceil(9 * sqrt(n)) + 21 AS BIGINT))) AS k FROM (SELECT DISTINCT n FROM cells WHERE n BETWEEN 1 AND {resample.EXACT}))),
    pl AS (SELECT n, list(cdf ORDER BY k) AS cdfs FROM pk GROUP BY n),
    dr AS (SELECT {', '.join([*by, *key])}, r, CASE WHEN r = 0 THEN n WHEN n = 0 THEN 0 WHEN n <= {resample.EXACT} THEN len(list_filter(cdfs, lambda c: c < u))
        ELSE CAST(greatest(0, round_even(n + sqrt(n) * z + (z * z - 1) / 6, 0)) AS BIGINT) END AS w
      FROM (SELECT *, {unit()} AS u, sqrt(-2 * ln(greatest({u1}, 1e-12))) * cos(2 * pi() * {u2}) AS z
        FROM (SELECT cells.*, cdfs, unnest(range({n_boot + 1})) AS r FROM cells LEFT JOIN pl USING (n))))"""


def _ends_sql(value: str, low: str, high: str) -> str:
    return (
        f"round(max({value}) FILTER (r = 0), 9) AS {value}, round(quantile_cont({value}, 0.025) FILTER (r > 0), 9) AS {low}, "
        f"round(quantile_cont({value}, 0.975) FILTER (r > 0), 9) AS {high}"
    )


_DELTA_CELLS = """cells AS (SELECT {by}, unnest(['b', 'c', 'rest']) AS cell, unnest([b, c, n - b - c]) AS n FROM ct), """
_DELTA = """dl AS (SELECT {by}, r, sum(CASE cell WHEN 'c' THEN w WHEN 'b' THEN -w ELSE 0 END) / nullif(sum(w), 0) AS delta FROM dr GROUP BY ALL)"""


@query("paired_bootstrap", with_views("preds", body=_PAIRED + ", " + _DELTA_CELLS.format(by="tag, k, model, subset") + _drawn_sql(["tag", "k", "model", "subset"], ["cell"], 4000) + ", "
    + _DELTA.format(by="tag, k, model, subset") + f""", e AS (SELECT tag, k, model, subset, {_ends_sql('delta', 'lo', 'hi')} FROM dl GROUP BY ALL)
    SELECT e.*, b, c, n, round({_P.format(b='b', c='c')}, 8) AS p FROM e JOIN ct USING (tag, k, model, subset)"""))
def paired_bootstrap_(spark, d):
    rows = resample.paired_summary(joins.paired_runs(predictions(spark, d), "dim64"), ["tag", "k", "model"], is_target, 4000)
    return _rounded(_rounded(rows, "delta", "lo", "hi"), "p", digits=8)


@query("model_pairs", with_views("preds", body=f"""
    , ok AS (SELECT tag, k, seed, model, key, y = pred AS ok FROM preds),
    ct AS (SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, count(*) FILTER (a.ok AND NOT b.ok) AS x, count(*) FILTER (NOT a.ok AND b.ok) AS z
      FROM ok a JOIN ok b ON a.tag = b.tag AND a.k = b.k AND a.seed = b.seed AND a.key = b.key AND a.model < b.model GROUP BY ALL)
    SELECT model_a, model_b, n, x AS a_better, z AS b_better, round({_P.format(b='x', c='z')}, 8) AS p_value,
      CASE WHEN x = z THEN 'tie' WHEN x > z THEN 'A' ELSE 'B' END AS winner FROM ct"""))
def model_pairs(spark, d):
    return _rounded(compare.all_pairs(predictions(spark, d), ["tag", "k", "seed", "key"]), "p_value", digits=8)


@query("cross_tag_pairs", with_views("preds", body=f"""
    , ok AS (SELECT tag, k, seed, model, key, y, y = pred AS ok FROM preds),
    ct AS (SELECT a.model, a.k, count(*) AS n, count(*) FILTER (a.ok AND NOT b.ok) AS b, count(*) FILTER (NOT a.ok AND b.ok) AS c
      FROM ok a JOIN ok b ON a.tag = 'uniform' AND b.tag = 'scarce' AND a.k = b.k AND a.seed = b.seed AND a.key = b.key AND a.model = b.model
      WHERE a.y < 3 GROUP BY ALL)
    SELECT model, k, n, b, c, round({_P.format(b='b', c='c')}, 8) AS p FROM ct"""))
def cross_tag_pairs(spark, d):
    pairs = joins.cross_tag_pairs(predictions(spark, d), "uniform", "scarce").filter(is_target(F.col("y")))
    counts = compare.discordant(pairs, ["model", "k"])
    return _rounded(counts.withColumn("p", mcnemar_p(F.col("b"), F.col("c"))), "p", digits=8)


_RUN = "tag, k, seed, model"


@query("bootstrap_intervals", with_views("preds", body=f"""
    , cells AS (SELECT {_RUN}, y, pred, count(*) AS n FROM preds GROUP BY ALL), {_drawn_sql(RUN, ["y", "pred"], 500)},
    sd AS (SELECT {_RUN}, r, y AS c, w AS own, CASE WHEN y = pred THEN w ELSE 0 END AS hit, w AS seen FROM dr UNION ALL SELECT {_RUN}, r, pred, 0, 0, w FROM dr),
    pc AS (SELECT {_RUN}, r, c, sum(own) AS own, sum(hit) AS hit, sum(seen) AS seen FROM sd GROUP BY ALL),
    m AS (SELECT {_RUN}, r, avg(hit / nullif(own, 0)) AS macro_acc, avg(2 * hit / nullif(seen, 0)) AS macro_f1 FROM pc GROUP BY ALL),
    e AS (SELECT {_RUN}, {_ends_sql('macro_acc', 'macro_acc_low', 'macro_acc_high')}, {_ends_sql('macro_f1', 'macro_f1_low', 'macro_f1_high')},
      round(0.9 - max(macro_acc) FILTER (r = 0), 9) AS val_test_gap FROM m GROUP BY ALL),
    o AS (SELECT {_RUN}, count(*) AS n, count(*) FILTER (y = pred) AS n_ok FROM preds GROUP BY ALL)
    SELECT e.*, n, round(n_ok / n, 9) AS overall, round(greatest(0, {_WILSON.format(op='-')}), 9) AS overall_low, round(least(1, {_WILSON.format(op='+')}), 9) AS overall_high
    FROM e JOIN o USING ({_RUN})"""))
def bootstrap_intervals(spark, d):
    rows = resample.split_scores(predictions(spark, d), RUN, F.lit(0.9), 500)
    return _rounded(rows, *[c for c in rows.columns if c not in RUN and c != "n"])


@query("bootstrap_macro_delta", with_views("preds", body=_PAIRED + f"""
    , cells AS (SELECT tag, k, model, y, a_ok, b_ok, count(*) AS n FROM pr GROUP BY ALL), {_drawn_sql(["tag", "k", "model"], ["y", "a_ok", "b_ok"], 500)},
    pc AS (SELECT tag, k, model, r, y, sum(w) AS n, sum(CASE WHEN a_ok THEN w ELSE 0 END) - sum(CASE WHEN b_ok THEN w ELSE 0 END) AS d FROM dr GROUP BY ALL),
    m AS (SELECT tag, k, model, r, avg(d / nullif(n, 0)) AS delta_macro_acc FROM pc GROUP BY ALL),
    e AS (SELECT tag, k, model, {_ends_sql('delta_macro_acc', 'low', 'high')} FROM m GROUP BY ALL)
    SELECT *, low > 0 AS a_beats_b, high < 0 AS b_beats_a FROM e"""))
def bootstrap_macro_delta(spark, d):
    rows = resample.macro_delta(joins.paired_runs(predictions(spark, d), "dim64"), ["tag", "k", "model"], 500)
    rows = _rounded(rows, "delta_macro_acc", "low", "high")
    return rows.withColumn("a_beats_b", F.col("low") > 0).withColumn("b_beats_a", F.col("high") < 0)


@query("custom_metric_bootstrap", with_views("preds", body=f"""
    , cells AS (SELECT tag, model, y, pred, count(*) AS n FROM preds GROUP BY ALL), {_drawn_sql(["tag", "model"], ["y", "pred"], 500)},
    m AS (SELECT tag, model, r, 1 - sum(CASE WHEN y = pred THEN w ELSE 0 END) / sum(w) AS point FROM dr GROUP BY ALL)
    SELECT tag, model, {_ends_sql('point', 'low', 'high')} FROM m GROUP BY ALL"""))
def custom_metric_bootstrap(spark, d):
    """Error rate, a metric given by the caller as an aggregate over weighted confusion cells."""
    error = 1 - F.sum(F.when(F.col("y") == F.col("pred"), F.col("w")).otherwise(0)) / F.sum("w")
    drawn = resample.resamples(score.confusion(predictions(spark, d), ["tag", "model"]), ["tag", "model"], ["y", "pred"], n_boot=500)
    rows = resample.metric_interval(drawn, ["tag", "model"], error)
    return _rounded(rows.withColumnsRenamed({"point_low": "low", "point_high": "high"}), "point", "low", "high")


_RUNS = """, runs AS (SELECT tag, k, seed, model, avg(CAST(y = pred AS INT)) AS top1,
    avg(CAST(y = pred AS INT)) FILTER (y < 3) AS target_top1 FROM preds GROUP BY ALL)"""


def _runs(spark, d):
    return score.run_metrics(predictions(spark, d), RUN, is_target)


@query("run_summary", with_views("preds", body=_RUNS + """
    , s AS (SELECT tag, model, k, avg(top1) AS m, stddev_samp(top1) AS sd, avg(target_top1) AS tm, count(DISTINCT seed) AS n_seeds FROM runs GROUP BY ALL)
    SELECT tag, model, k, round(m, 9) AS top1_mean, round(sd, 9) AS top1_std, round(tm, 9) AS target_top1_mean, n_seeds,
      abs(m - max(m) OVER (PARTITION BY tag, k)) < 1e-9 AS is_best FROM s"""))
def run_summary(spark, d):
    summary = compare.summarise(_runs(spark, d), ["tag", "model", "k"], ["top1", "target_top1"]).drop("target_top1_std")
    return _rounded(compare.flag_best(summary, "top1_mean", ["tag", "k"]), "top1_mean", "top1_std", "target_top1_mean")


@query("run_pivot", with_views("preds", body=_RUNS + """
    , s AS (SELECT model || '/' || tag AS model, k, avg(top1) AS m, stddev_samp(top1) AS sd FROM runs GROUP BY ALL)
    SELECT model, """ + ", ".join(f'round(max(m) FILTER (k = {k}), 9) AS "{k}_mean", round(max(sd) FILTER (k = {k}), 9) AS "{k}_std"' for k in SHOTS) + " FROM s GROUP BY model"))
def run_pivot(spark, d):
    runs = _runs(spark, d).withColumn("model", F.concat_ws("/", "model", "tag"))
    summary = compare.summarise(runs, ["model", "k"], ["top1"])
    wide = compare.pivot_shots(summary, "top1", list(SHOTS))
    return wide.select("model", *[F.round(c, 9).alias(c) for c in wide.columns if c != "model"])


@query("result_summary", """
    SELECT o_orderpriority AS model, year(o_orderdate) AS k, round(avg(o_totalprice), 5) AS price_mean,
      round(CASE WHEN count(o_totalprice) = 1 THEN 0 ELSE stddev_samp(o_totalprice) END, 5) AS price_std, count(DISTINCT o_custkey) AS n_seeds
    FROM (SELECT * REPLACE (CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice) FROM orders) GROUP BY ALL""")
def result_summary(spark, d):
    orders = table(spark, d, "orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_custkey", "o_orderstatus")
    missing = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    runs = orders.select(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("k"), missing.alias("price"), F.col("o_custkey").alias("seed"))
    seen = compare.summarise(runs, ["model", "k"], ["price"], single_std_zero=True)
    return _rounded(seen, "price_mean", "price_std", digits=5)


@query("consistency_checks", """
    WITH c AS (SELECT o_orderpriority AS tag, o_custkey AS seed, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY ALL)
    SELECT tag, count(*) FILTER (n > 1) AS conflicting, count(*) FILTER (n < 3) AS short FROM c GROUP BY tag""")
def consistency_checks(spark, d):
    runs = table(spark, d, "orders", "o_orderpriority", "o_custkey", "o_orderstatus").toDF("tag", "seed", "fp")
    bad = compare.fingerprint_conflicts(runs, ["tag", "seed"], "fp").groupBy("tag").agg(F.count(F.lit(1)).alias("conflicting"))
    short = compare.short_cells(runs, ["tag", "seed"], "fp").groupBy("tag").agg(F.count(F.lit(1)).alias("short"))
    return bad.join(short, "tag", "full").select("tag", F.coalesce("conflicting", F.lit(0)).alias("conflicting"), F.coalesce("short", F.lit(0)).alias("short"))


@query("chance_level", with_views("preds", body="""
    SELECT tag, model, round(1.0 / count(DISTINCT y), 9) AS chance, min(s) AS min_seeds, max(s) AS max_seeds FROM (
      SELECT *, count(DISTINCT seed) OVER (PARTITION BY tag, model, k) AS s FROM preds) GROUP BY ALL"""))
def chance_level(spark, d):
    preds = predictions(spark, d)
    seeds = preds.groupBy("tag", "model", "k").agg(F.count_distinct("seed").alias("s"))
    spread = seeds.groupBy("tag", "model").agg(F.min("s").alias("min_seeds"), F.max("s").alias("max_seeds"))
    words = preds.groupBy("tag", "model").agg(F.round(1 / F.count_distinct("y"), 9).alias("chance"))
    return words.join(spread, ["tag", "model"])


@query("batch_totals", """
    SELECT o_orderpriority AS run, round(sum(o_totalprice * n) / sum(n), 4) AS loss, round(sum(ok * n) / sum(n), 9) AS acc, sum(n) AS n
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n, avg(l_discount) AS ok FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""")
def batch_totals(spark, d):
    line = table(spark, d, "lineitem", "l_orderkey", "l_discount")
    sizes = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("size"), F.avg("l_discount").alias("ok"))
    rows = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").join(sizes, "o_orderkey")
    out = score.weighted_mean(rows.withColumnRenamed("o_orderpriority", "run"), ["run"], "o_totalprice", "ok", "size")
    return _rounded(_rounded(out, "loss", digits=4), "acc")


_ORDERS_AS_RUNS = """, runs AS (SELECT o_orderpriority AS model, o_totalprice AS train_seconds, 1 + o_orderkey % 7 AS steps,
    CASE WHEN o_orderstatus = 'F' THEN 'Tesla T4' ELSE 'laptop' END AS gpu FROM orders)"""


@query("cost_calibrate", "WITH z AS (SELECT 1)" + _ORDERS_AS_RUNS + """,
    cal AS (SELECT model, quantile_cont(train_seconds / steps, 0.5) AS sec FROM runs WHERE gpu LIKE '%T4%' AND model <> '5-LOW' GROUP BY 1)
    SELECT r.model, count(*) AS jobs, round(sum((steps * coalesce(sec, 0.03) * CASE WHEN gpu = 'laptop' THEN 0.6 ELSE 1 END + 15.0)
      * CASE WHEN gpu = 'laptop' THEN 2 ELSE 1 END), 4) AS cost FROM runs r LEFT JOIN cal USING (model) GROUP BY r.model""")
def cost_calibrate(spark, d):
    runs = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus").select(
        F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("train_seconds"), (1 + F.pmod("o_orderkey", F.lit(7))).alias("steps"),
        F.when(F.col("o_orderstatus") == "F", "Tesla T4").otherwise("laptop").alias("gpu"),
    )
    done = compare.calibrate(runs.filter(F.col("model") != "5-LOW"))
    jobs = runs.withColumn("ddp", F.col("gpu") == "laptop")
    cost = compare.job_cost(jobs, done, fixed.STEP_SECONDS, fixed.DEFAULT_STEP_SECONDS, fixed.JOB_OVERHEAD_SECONDS)
    return _rounded(cost.groupBy("model").agg(F.count(F.lit(1)).alias("jobs"), F.sum("cost").alias("cost")), "cost", digits=4)


@query("sweep_plan", with_views("ranks", body="""
    , g AS (SELECT tag, nw, k, seed, model, (tag_i * 4 + ki) * 3 + seed AS pos FROM
      (SELECT 'uniform' AS tag, NULL AS nw, 0 AS tag_i UNION ALL SELECT 'scarce_t3', NULL, 1 UNION ALL SELECT 'scarce_t3_V8', 8, 2)
      CROSS JOIN (SELECT unnest([1, 2, 4, 8]) AS k, unnest([0, 1, 2, 3]) AS ki) CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed) CROSS JOIN (SELECT 'hwgat' AS model)),
    n AS (SELECT seed, label, count(*) AS n FROM ranks WHERE NOT is_test GROUP BY ALL),
    t AS (SELECT g.tag, g.k, g.seed, sum(CASE WHEN label < 3 OR tag = 'uniform' THEN least(n, k) ELSE n END) AS n_train FROM g JOIN n ON g.seed = n.seed GROUP BY ALL)
    SELECT g.tag || '/' || model || '/K' || g.k || '/s' || g.seed AS name, n_train,
      CAST(least(5000, greatest(300, ceil(80 * n_train / ceil(greatest(least(16, n_train), 4) / 2.0) / 2))) AS BIGINT) AS steps,
      CAST(ceil(greatest(least(16, n_train), 4) / 2.0) * 2 AS BIGINT) AS batch FROM g JOIN t USING (tag, k, seed)"""))
def sweep_plan(spark, d):
    """Grid jobs with run names, training sizes from the data, batch size and step budget."""
    grid = joins.expand_grid(
        spark, {"k": list(SHOTS), "seed": list(SEEDS)},
        [{"protocol": "uniform"}, {"protocol": "scarce"}, {"protocol": "scarce", "n_words": 8}, {"protocol": "uniform"}],
        {"protocol": "scarce", "n_words": None, "model": "HWGAT"},
    )
    empty = F.array().cast("array<string>")
    tag = text.protocol_tag(F.col("protocol"), F.lit("t3"), F.lit(None), F.col("n_words"), empty, empty)
    named = grid.withColumn("tag", tag).withColumn("name", text.run_name(F.col("tag"), F.col("model"), F.col("k"), F.col("seed")))
    jobs = take_first(named, ["name"], ["pos"])
    pool = views.split_ranks(spark, d).filter(~F.col("is_test")).groupBy("seed", "label").agg(F.count(F.lit(1)).alias("n"))
    few = is_target(F.col("label")) | (F.col("protocol") == "uniform")
    sized = jobs.join(pool, "seed").groupBy("name").agg(F.sum(F.when(few, F.least("n", "k")).otherwise(F.col("n"))).alias("n_train"))
    batch = compare.effective_batch(F.lit(16), F.col("n_train"), 2)
    return sized.withColumn("batch", batch).withColumn("steps", compare.step_budget(F.col("n_train"), F.col("batch"), 80, 300, 5000))


@query("wilson_bounds", """
    SELECT p_brand, n, n_ok AS k, round(""" + _WILSON.format(op="-") + ", 9) AS low, round(" + _WILSON.format(op="+") + """, 9) AS high FROM (
      SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 20) AS n_ok FROM part GROUP BY 1)""")
def wilson_bounds(spark, d):
    rows = table(spark, d, "part", "p_brand", "p_size").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 20).alias("k"))
    ci = wilson(F.col("k"), F.col("n"))
    return rows.select("p_brand", "n", "k", F.round(ci["low"], 9).alias("low"), F.round(ci["high"], 9).alias("high"))


@query("discordant_large", f"""
    SELECT p_brand, b, c, round({_P.format(b='b', c='c')}, 8) AS p FROM (
      SELECT p_brand, count(*) FILTER (l_discount < 0.04) AS b, count(*) FILTER (l_discount > 0.06) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)""")
def discordant_large(spark, d):
    line = table(spark, d, "lineitem", "l_partkey", "l_discount").withColumnRenamed("l_partkey", "p_partkey")
    rows = line.join(table(spark, d, "part", "p_partkey", "p_brand"), "p_partkey")
    counts = rows.groupBy("p_brand").agg(F.count_if(F.col("l_discount") < 0.04).alias("b"), F.count_if(F.col("l_discount") > 0.06).alias("c"))
    return _rounded(counts.withColumn("p", mcnemar_p(F.col("b"), F.col("c"))), "p", digits=8)


@query("bootstrap_counts", f"""
    WITH ct AS (SELECT l_returnflag, count(*) FILTER (l_discount > 0.05 AND l_tax <= 0.04) AS b, count(*) FILTER (l_discount <= 0.05 AND l_tax > 0.04) AS c, count(*) AS n
      FROM lineitem GROUP BY 1), {_DELTA_CELLS.format(by='l_returnflag')}{_drawn_sql(['l_returnflag'], ['cell'], 2000)}, {_DELTA.format(by='l_returnflag')},
    e AS (SELECT l_returnflag, {_ends_sql('delta', 'low', 'high')} FROM dl GROUP BY 1)
    SELECT * FROM e JOIN ct USING (l_returnflag)""")
def bootstrap_counts(spark, d):
    """Interval of an accuracy difference over all line items per return flag, from three counts each."""
    line = table(spark, d, "lineitem", "l_returnflag", "l_discount", "l_tax")
    counts = line.groupBy("l_returnflag").agg(
        F.count_if((F.col("l_discount") > 0.05) & (F.col("l_tax") <= 0.04)).alias("b"),
        F.count_if((F.col("l_discount") <= 0.05) & (F.col("l_tax") > 0.04)).alias("c"), F.count(F.lit(1)).alias("n"),
    )
    rows = resample.delta_interval(counts, ["l_returnflag"]).withColumnsRenamed({"delta_low": "low", "delta_high": "high"})
    return _rounded(rows, "delta", "low", "high")
