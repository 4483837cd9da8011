"""Queries on split protocols."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossloom.functions.hashing import seeded_order
from glossloom.operators import holdout, joins, reports, splits
from glossloom.operators.ranking import hash_rank
from glossloom.plans import views
from glossloom.plans.registry import query
from glossloom.plans.views import TARGETS, fingerprint_sql, with_views
from glossloom.session import checkpoint

PAIR = ["key", "word", "source", "identity"]


def _identified(spark, d):
    return views.identified(spark, d).select(*PAIR)


def _walk(seeds: str, salt: str, limits: str, verdict: str, view: str = "ident") -> str:
    """Recursive SQL twin of the greedy holdout: one identity per step and seed."""
    return f""", idc AS (SELECT identity, word, count(*) AS n FROM {view} GROUP BY ALL),
    tot AS (SELECT word, sum(n) AS n FROM idc GROUP BY word),
    lim AS (SELECT word, row_number() OVER (ORDER BY word) AS ix, {limits} FROM tot),
    lst AS (SELECT list(target ORDER BY word) AS target, list(cap ORDER BY word) AS cap, list(0 ORDER BY word) AS zero FROM lim),
    ids AS (SELECT seed, identity, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|{salt}|' || identity), identity) AS rn
      FROM (SELECT DISTINCT identity FROM idc) CROSS JOIN (SELECT unnest({seeds}) AS seed)),
    cnt AS (SELECT identity, list(coalesce(n, 0) ORDER BY word) AS cnt FROM (SELECT DISTINCT identity FROM idc) CROSS JOIN lim
      LEFT JOIN idc USING (identity, word) GROUP BY identity),
    items AS MATERIALIZED (SELECT seed, rn, identity, cnt, target, cap FROM ids JOIN cnt USING (identity) CROSS JOIN lst),
    walk AS (SELECT DISTINCT seed, CAST(0 AS BIGINT) AS rn, '' AS identity, false AS taken, list_transform(zero, lambda x: CAST(x AS BIGINT)) AS have FROM ids CROSS JOIN lst
      UNION ALL
      SELECT seed, rn, identity, t, CASE WHEN t THEN list_transform(range(1, len(have) + 1), lambda x: CAST(have[x] + cnt[x] AS BIGINT)) ELSE have END FROM (
        SELECT w.seed, i.rn, i.identity, w.have, i.cnt, {verdict} AND
          len(list_filter(range(1, len(have) + 1), lambda x: cnt[x] > 0 AND have[x] + cnt[x] > cap[x])) = 0 AS t
        FROM walk w JOIN items i ON i.seed = w.seed AND i.rn = w.rn + 1)),
    held AS (SELECT seed, identity FROM walk WHERE taken)"""


_LIMITS = """least(greatest(2, CAST(round_even(0.25 * n, 0) AS BIGINT)), 20) AS target,
    greatest(least(greatest(2, CAST(round_even(0.25 * n, 0) AS BIGINT)), 20), CAST(floor(0.5 * n) AS BIGINT)) AS cap"""
_HELPS = "len(list_filter(range(1, len(have) + 1), lambda x: cnt[x] > 0 AND have[x] < target[x])) > 0"
_TEST = _walk("[0, 1]", "test", _LIMITS, _HELPS)
_LOCK = _walk("[42]", "lock", "15 AS target, n - least(8, greatest(0, n - 1)) AS cap", "len(list_filter(range(1, len(have) + 1), lambda x: have[x] < target[x])) > 0")
_POOL = """, pool AS (SELECT key, word, source, identity, md5('0|pool|' || word || '|' || key) AS h, md5('0|pool|' || word || '|' || identity) AS ih
      FROM ident WHERE identity NOT IN (SELECT identity FROM held WHERE seed = 0)),
    turns AS (SELECT *, row_number() OVER (PARTITION BY word, identity ORDER BY h, key) AS p FROM pool),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY p, ih, identity, h, key) AS pool_rank FROM turns)"""
_SPLIT = """, split AS (SELECT key, word, identity, 'train' AS side FROM ranked WHERE {train}
    UNION ALL SELECT key, word, identity, 'test' FROM ident WHERE identity IN (SELECT identity FROM held WHERE seed = 0))"""
_SCARCE = "pool_rank <= 4 OR word NOT IN ('click', 'view')"


@query("fixed_test", with_views("ident", body=_TEST + " SELECT seed, identity FROM held"))
def fixed_test(spark, d):
    return holdout.fixed_test(_identified(spark, d), [0, 1])


@query("test_counts", with_views("ident", body=_TEST + """
    SELECT seed, word, count(identity) FILTER (identity IS NOT NULL) AS n_test FROM (
      SELECT s.seed, w.word, x.identity FROM (SELECT unnest([0, 1]) AS seed) s CROSS JOIN (SELECT DISTINCT word FROM ident) w
      LEFT JOIN (SELECT h.seed, h.identity, i.word FROM held h JOIN ident i USING (identity)) x ON x.seed = s.seed AND x.word = w.word) GROUP BY ALL"""))
def test_counts(spark, d):
    clips = _identified(spark, d)
    held = holdout.fixed_test(clips, [0, 1])
    words = clips.select("word").distinct()
    out = None
    for s in (0, 1):
        test = clips.join(held.filter(F.col("seed") == s), "identity", "left_semi")
        part = reports.test_counts(words, test).withColumn("seed", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


@query("pool_round_robin", with_views("ident", body="""
    , t AS (SELECT key, word, identity, md5('0|pool|' || word || '|' || key) AS h, md5('0|pool|' || word || '|' || identity) AS ih,
      row_number() OVER (PARTITION BY word, identity ORDER BY md5('0|pool|' || word || '|' || key), key) AS p FROM ident)
    SELECT key, word, row_number() OVER (PARTITION BY word ORDER BY p, ih, identity, h, key) AS pool_rank FROM t"""))
def pool_round_robin(spark, d):
    return splits.pool_order(_identified(spark, d), 0).select("key", "word", "pool_rank")


@query("nested_shots", with_views("ident", body="""
    , t AS (SELECT key, word, identity, md5('0|pool|' || word || '|' || key) AS h, md5('0|pool|' || word || '|' || identity) AS ih,
      row_number() OVER (PARTITION BY word, identity ORDER BY md5('0|pool|' || word || '|' || key), key) AS p FROM ident),
    r AS (SELECT key, word, row_number() OVER (PARTITION BY word ORDER BY p, ih, identity, h, key) AS pool_rank FROM t)
    SELECT k, word, key FROM r CROSS JOIN (SELECT unnest([1, 2, 4, 8, 16]) AS k) WHERE pool_rank <= k"""))
def nested_shots(spark, d):
    top = splits.pool_first(_identified(spark, d), 0, 16)
    rows = top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 8, 16)])))
    return rows.filter(F.col("pool_rank") <= F.col("k")).select("k", "word", "key")


@query("vocab_subset", with_views("clips", body="""
    , w AS (SELECT DISTINCT word || ' ' || k AS word FROM clips)
    SELECT word FROM w WHERE word IN ('click 1', 'view 2', 'not there') UNION ALL
    SELECT word FROM (SELECT word, row_number() OVER (ORDER BY md5('3|vocab|' || word), word) AS r FROM w WHERE word NOT IN ('click 1', 'view 2', 'not there'))
    WHERE r <= 50 - (SELECT count(*) FROM w WHERE word IN ('click 1', 'view 2', 'not there'))"""))
def vocab_subset(spark, d):
    words = views.clips(spark, d).select(F.concat_ws(" ", "word", F.col("k").cast("string")).alias("word")).distinct()
    return splits.vocabulary_subset(words, ["click 1", "view 2", "not there"], 50, 3)


@query("scarce_split", with_views("ident", body=_TEST + _POOL + _SPLIT.format(train=_SCARCE) + " SELECT key, word, side FROM split"))
def scarce_split(spark, d):
    how = {"protocol": "scarce", "shots": 4, "targets": TARGETS}
    return splits.make_split(_identified(spark, d), **how).select("key", "word", "side")


@query("uniform_split", with_views("ident", body=_TEST + _POOL + _SPLIT.format(train="pool_rank <= 8") + " SELECT key, word, side FROM split"))
def uniform_split(spark, d):
    how = {"protocol": "uniform", "shots": 8, "targets": TARGETS}
    return splits.make_split(_identified(spark, d), **how).select("key", "word", "side")


@query("full_split", with_views("ident", body=_TEST + _POOL + _SPLIT.format(train="true") + " SELECT key, word, side FROM split"))
def full_split(spark, d):
    how = {"protocol": "full", "shots": None, "targets": TARGETS}
    return splits.make_split(_identified(spark, d), **how).select("key", "word", "side")


@query("cross_source_split", with_views("ident", body="""
    , tr AS (SELECT key, word, identity, md5('0|pool|' || word || '|' || key) AS h, md5('0|pool|' || word || '|' || identity) AS ih,
      row_number() OVER (PARTITION BY word, identity ORDER BY md5('0|pool|' || word || '|' || key), key) AS p
      FROM ident WHERE source IN ('studio', 'camera') AND word IN (SELECT word FROM ident WHERE source = 'web'))
    SELECT key, word, 'train' AS side FROM tr QUALIFY row_number() OVER (PARTITION BY word ORDER BY p, ih, identity, h, key) <= 8
    UNION ALL SELECT key, word, 'test' FROM ident WHERE source = 'web' AND word IN (SELECT word FROM tr)"""))
def cross_source_split(spark, d):
    how = {"protocol": "cross_source", "shots": 8, "targets": TARGETS, "sources": (["studio", "camera"], ["web"])}
    return splits.make_split(_identified(spark, d), **how).select("key", "word", "side")


@query("split_invariants", with_views("ident", body=_TEST + _POOL + _SPLIT.format(train=_SCARCE) + """
    SELECT (SELECT count(*) FROM (SELECT identity FROM split GROUP BY 1 HAVING count(DISTINCT side) > 1)) AS leaked_identities,
      (SELECT count(*) FROM (SELECT key FROM split GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys"""))
def split_invariants(spark, d):
    how = {"protocol": "scarce", "shots": 4, "targets": TARGETS}
    return splits.split_invariants(checkpoint(splits.make_split(_identified(spark, d), **how)))


@query("split_info", with_views("ident", body=_TEST + _POOL + _SPLIT.format(train=_SCARCE) + """
    SELECT count(DISTINCT word) AS n_words, count(*) FILTER (side = 'train') AS n_train, count(*) FILTER (side = 'test') AS n_test,
      count(*) FILTER (side = 'test' AND word IN ('click', 'view')) AS n_test_target, 'click,view' AS targets, 'zebra' AS missing_targets,
      {train} AS train_fingerprint, {test} AS test_fingerprint,
      count(DISTINCT identity) FILTER (side = 'train') AS n_train_identities, count(DISTINCT identity) FILTER (side = 'test') AS n_test_identities FROM split""".replace(
    "{train}", fingerprint_sql("key", "side = 'train'")).replace("{test}", fingerprint_sql("key", "side = 'test'"))))
def split_info(spark, d):
    how = {"protocol": "scarce", "shots": 4, "targets": TARGETS}
    info = reports.split_info(checkpoint(splits.make_split(_identified(spark, d), **how)), [*TARGETS, "zebra"], 4)
    text = [F.array_join(c, ",").alias(c) for c in ("targets", "missing_targets")]
    names = ["n_words", "n_train", "n_test", "n_test_target", "train_fingerprint", "test_fingerprint", "n_train_identities", "n_test_identities"]
    return info.select(*names, *text)


@query("feasibility", with_views("ident", body=_TEST + """
    , s AS (SELECT seed, word, count(*) FILTER (NOT h) AS n_pool, count(*) FILTER (h) AS n_test FROM (
      SELECT s.seed, i.word, EXISTS (SELECT 1 FROM held WHERE held.seed = s.seed AND held.identity = i.identity) AS h
      FROM ident i CROSS JOIN (SELECT unnest([0, 1]) AS seed) s) GROUP BY ALL)
    SELECT seed, k, count(*) AS words, count(*) FILTER (word IN ('click', 'view')) AS targets,
      sum(CASE WHEN word IN ('click', 'view') THEN least(n_pool, k) ELSE n_pool END) AS train, sum(n_test) AS test,
      sum(n_test) FILTER (word IN ('click', 'view')) AS test_targets, count(*) FILTER (n_test = 0) AS words_without_test,
      count(*) FILTER (word IN ('click', 'view') AND n_pool < k) AS targets_short
    FROM s CROSS JOIN (SELECT unnest([1, 4, 16, 500]) AS k) GROUP BY ALL"""))
def feasibility(spark, d):
    clips = _identified(spark, d)
    held = holdout.fixed_test(clips, [0, 1]).withColumn("_t", F.lit(True))
    rows = clips.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1)))).join(held, ["seed", "identity"], "left")
    test = rows.filter("_t").groupBy("seed", "word").agg(F.count(F.lit(1)).alias("n_test"))
    pool = rows.filter(F.col("_t").isNull()).groupBy("seed", "word").agg(F.count(F.lit(1)).alias("n_pool"))
    return reports.feasibility(pool, test, [1, 4, 16, 500], list(TARGETS))


@query("fewshot_lock", with_views("ident", body=_LOCK + " SELECT identity FROM held"))
def fewshot_lock(spark, d):
    return holdout.lock_identities(_identified(spark, d), 42).select("identity")


_FEW = """, fs AS (
    SELECT draw, key, word, identity, 'test' AS side FROM (SELECT * FROM ident WHERE identity IN (SELECT identity FROM held)
      QUALIFY row_number() OVER (PARTITION BY word ORDER BY md5('42|test|' || key), key) <= 15) CROSS JOIN (SELECT unnest([42, 1051]) AS draw)
    UNION ALL
    SELECT draw, key, word, identity, CASE WHEN r <= least(7, n - least(1, n - 1)) THEN 'train' ELSE 'val' END FROM (
      SELECT *, row_number() OVER (PARTITION BY draw, word ORDER BY md5(draw || '|draw|' || key), key) AS r, count(*) OVER (PARTITION BY draw, word) AS n
      FROM ident CROSS JOIN (SELECT unnest([42, 1051]) AS draw) WHERE identity NOT IN (SELECT identity FROM held)) WHERE r <= least(7, n - least(1, n - 1)) + least(1, n - 1))"""


@query("fewshot_draws", with_views("ident", body=_LOCK + _FEW + " SELECT draw, key, word, side FROM fs"))
def fewshot_draws(spark, d):
    return splits.fewshot_split(_identified(spark, d), draw_seeds=[42, 42 + 1009]).select("draw", "key", "word", "side")


@query("fewshot_audit", with_views("ident", body=_LOCK + _FEW + """
    , a AS (SELECT draw, word, count(*) FILTER (side = 'train') AS n_train, count(*) FILTER (side = 'val') AS n_val, count(*) FILTER (side = 'test') AS n_test,
      string_agg(DISTINCT identity, ',' ORDER BY identity) FILTER (side = 'train') AS train_ids, string_agg(DISTINCT identity, ',' ORDER BY identity) FILTER (side = 'val') AS val_ids,
      string_agg(DISTINCT identity, ',' ORDER BY identity) FILTER (side = 'test') AS test_ids FROM fs GROUP BY ALL)
    SELECT a.*, n_pool, CASE WHEN n_test < 15 THEN n_pool || ' clips, test=' || n_test || ' (wanted 15)' ELSE '' END AS warnings
    FROM a JOIN (SELECT word, count(*) AS n_pool FROM ident GROUP BY word) USING (word)"""))
def fewshot_audit(spark, d):
    clips = _identified(spark, d)
    return splits.fewshot_audit(splits.fewshot_split(clips, draw_seeds=[42, 42 + 1009]), clips)


@query("fewshot_spec", with_views("ident", body=_LOCK + _FEW + """
    SELECT min(n) >= 15 AS meets_spec FROM (SELECT count(*) FILTER (side = 'test') AS n FROM fs GROUP BY draw, word)"""))
def fewshot_spec(spark, d):
    clips = _identified(spark, d)
    return splits.meets_spec(splits.fewshot_audit(splits.fewshot_split(clips, draw_seeds=[42, 42 + 1009]), clips))


@query("stratified_split", with_views("emb", body="""
    , r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM emb),
    s AS (SELECT *, greatest(1, CAST(round_even(n * 0.15, 0) AS BIGINT)) AS q FROM r)
    SELECT vec_id, label, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN r = 1 THEN 'train' ELSE 'val' END
      WHEN r <= CASE WHEN 2 * q >= n THEN 1 ELSE q END THEN 'test' WHEN r <= CASE WHEN 2 * q >= n THEN 2 ELSE 2 * q END THEN 'val' ELSE 'train' END AS side FROM s"""))
def stratified_split(spark, d):
    rows = views.table(spark, d, "embeddings", "vec_id", "label")
    return splits.stratified_split(rows, "label", "vec_id")


@query("epoch_order", with_views("emb", body="""
    , r AS (SELECT vec_id, e AS epoch, row_number() OVER (PARTITION BY e ORDER BY md5('7|epoch|' || e || '|' || vec_id), vec_id) AS r, (SELECT count(*) FROM emb) AS n
      FROM emb CROSS JOIN (SELECT unnest([0, 1, 2]) AS e))
    SELECT epoch, vec_id, (epoch * n + r - 1) // 16 AS step, (epoch * n + r - 1) % 16 AS slot FROM r"""))
def epoch_order(spark, d):
    return splits.epoch_order(views.table(spark, d, "embeddings", "vec_id"), "vec_id", 7, 3, 16)


@query("balanced_batches", with_views("emb", body="""
    , r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7|clip|' || vec_id), vec_id) AS r FROM emb),
    c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS ix FROM emb GROUP BY label),
    d AS (SELECT i, ('0x' || md5('7|class|' || i)[1:12])::BIGINT % (SELECT count(*) FROM c) AS ix, ('0x' || md5('7|item|' || i)[1:12])::BIGINT AS pick
      FROM (SELECT unnest(range(800)) AS i))
    SELECT i // 16 AS step, i % 16 AS slot, c.label, r.vec_id FROM d JOIN c USING (ix) JOIN r ON r.label = c.label AND r.r = pick % c.n + 1"""))
def balanced_batches(spark, d):
    return splits.balanced_batches(views.table(spark, d, "embeddings", "vec_id", "label"), "vec_id", "label", 7, 50, 16)


@query("locked_rows", with_views("ident", body="""
    , l AS (SELECT CASE WHEN k < 50 THEN video_rel ELSE '/data/' || video_rel END AS path, event_id AS pos FROM clips WHERE source <> 'web'),
    m AS (SELECT key, video_rel, '/data/' || video_rel AS abs_path FROM clips WHERE source <> 'dictionary')
    SELECT l.path, l.pos, m.key, m.key IS NOT NULL AS found FROM l LEFT JOIN m ON l.path = m.video_rel OR l.path = m.abs_path"""))
def locked_rows(spark, d):
    clips = views.clips(spark, d)
    full = F.concat(F.lit("/data/"), "video_rel")
    path = F.when(F.col("k") < 50, F.col("video_rel")).otherwise(full)
    paths = clips.filter(F.col("source") != "web").select(path.alias("path"), F.col("key").cast("bigint").alias("pos"))
    meta = clips.filter(F.col("source") != "dictionary").select("key", F.col("video_rel").alias("video_path"), full.alias("abs_path"))
    return joins.locked_rows(meta, paths).select("path", "pos", "key", "found").orderBy("pos")


@query("word_modes", with_views("clips", body="""
    , w AS (SELECT word || ' ' || k AS word, count(*) AS n FROM clips GROUP BY 1)
    SELECT 'all' AS mode, word FROM w UNION ALL SELECT 'top5', word FROM (SELECT word FROM w ORDER BY n DESC, word LIMIT 5)
    UNION ALL SELECT 'list', word FROM w WHERE word IN ('click 7', 'view 9')"""))
def word_modes(spark, d):
    fine = views.clips(spark, d).select(F.concat_ws(" ", "word", F.col("k").cast("string")).alias("word"))
    mode = lambda raw, name: joins.resolve_words(fine, raw).select(F.lit(name).alias("mode"), "word")
    return mode(["all"], "all").unionByName(mode(["top5"], "top5")).unionByName(mode(["Click_7", "VIEW 9", "nothing"], "list"))


@query("seeded_order", with_views("emb", body="""
    SELECT vec_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|order|' || vec_id), vec_id) AS rank
    FROM emb CROSS JOIN (SELECT unnest([0, 1]) AS seed)"""))
def seeded_order_(spark, d):
    rows = views.table(spark, d, "embeddings", "vec_id").withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("_h", seeded_order(F.col("seed"), "order", F.col("vec_id")))
    return hash_rank(rows, ["seed"], "_h", "rank", ["vec_id"]).drop("_h")
