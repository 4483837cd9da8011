"""Queries on labels, coverage, joins and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.functions import text
from glossloom.functions.hashing import key_fingerprint, seeded_order, shard_of
from glossloom.operators import dedup, joins, ranking, reports, sessions
from glossloom.plans import views
from glossloom.plans.registry import query
from glossloom.plans.views import table, with_views
from glossloom.session import checkpoint
from glossloom.sources import clips as clip_sources
from glossloom.sources import listings, results, sinks

FINE = "word || ' ' || k"


def _fine(spark, d):
    """Clips with a finer vocabulary: word and k."""
    return views.clips(spark, d).withColumn("word", F.concat_ws(" ", "word", F.col("k").cast("string")))


@query("word_coverage", with_views("clips", body=f"""
    , fine AS (SELECT {FINE} AS word, signer, source FROM clips),
    targets AS (SELECT DISTINCT word FROM fine UNION ALL SELECT 'never seen')
    SELECT t.word, count(f.word) AS videos_found, count(DISTINCT f.signer) AS unique_signers,
      coalesce(string_agg(DISTINCT f.source, ', ' ORDER BY f.source), 'none') AS sources, count(f.word) >= 40 AS target_met,
      CASE WHEN count(f.word) >= 40 THEN 'ok' WHEN count(f.word) > 0 THEN 'partial' ELSE 'missing' END AS status
    FROM targets t LEFT JOIN fine f ON t.word = f.word GROUP BY t.word"""))
def word_coverage(spark, d):
    fine = _fine(spark, d)
    never = fine.select(F.max(F.lit("never seen")).alias("word"))
    return reports.word_coverage(fine.select("word").distinct().unionByName(never), fine)


@query("global_statistics", with_views("clips", body="""
    SELECT unnest(['accepted_videos', 'unique_signers', 'source_datasets', 'target_words', 'datasets_searched']) AS metric,
      unnest([count(*), count(DISTINCT signer), count(DISTINCT source), 8, 4]) AS value FROM clips"""))
def global_statistics(spark, d):
    rows = views.clips(spark, d).withColumnRenamed("source", "dataset")
    return reports.global_statistics(rows, len(fixed.TARGET_WORDS), datasets_searched=4)


@query("source_rollup", with_views("ident", body="""
    SELECT source, count(*) AS clips, count(DISTINCT word) AS words, count(DISTINCT identity) AS identities,
      count(*) FILTER (signer <> '') AS signer_ids, quantile_cont(n_frames, 0.5) AS median_frames,
      array_to_string(list_sort(list(DISTINCT license))[1:2], '; ') AS licence FROM ident GROUP BY source
    UNION ALL SELECT 'ALL', count(*), count(DISTINCT word), count(DISTINCT identity), NULL, quantile_cont(n_frames, 0.5), '' FROM ident"""))
def source_rollup(spark, d):
    return reports.source_table(views.identified(spark, d))


@query("clips_per_word", with_views("clips", body=f"""
    SELECT min(n) AS min_clips, quantile_cont(n, 0.5) AS median_clips, max(n) AS max_clips,
      count(*) FILTER (n >= 3) AS words_enough, count(*) AS n_words FROM (SELECT count(*) AS n FROM clips GROUP BY {FINE})"""))
def clips_per_word(spark, d):
    return reports.clips_per_word(_fine(spark, d))


@query("top_words", with_views("clips", body=f"""
    SELECT {FINE} AS word, count(*) AS n FROM clips GROUP BY 1 ORDER BY n DESC, word LIMIT 8"""))
def top_words(spark, d):
    return joins.top_words(_fine(spark, d))


@query("capped_per_word", with_views("clips", body="""
    SELECT key, word FROM clips QUALIFY row_number() OVER (PARTITION BY word ORDER BY md5('0|' || key), key) <= 40"""))
def capped_per_word(spark, d):
    rows = views.clips(spark, d).select("key", "word").withColumn("_h", seeded_order(0, F.col("key")))
    return ranking.cap_per_group(rows, ["word"], "_h", 40, ["key"]).drop("_h")


@query("eligible_words", with_views("clips", body=f"""
    SELECT {FINE} AS word, count(*) AS n FROM clips GROUP BY 1 HAVING count(*) >= 15"""))
def eligible_words(spark, d):
    counts = _fine(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= 15)


@query("label_map", with_views("clips", body=f"""
    SELECT word, row_number() OVER (ORDER BY word) - 1 AS label FROM (SELECT DISTINCT {FINE} AS word FROM clips)"""))
def label_map(spark, d):
    words = _fine(spark, d).select("word").distinct()
    return ranking.range_rank(words, [], [F.col("word")], "rank").select("word", (F.col("rank") - 1).alias("label"))


_LABEL = "'  ' || upper(p_name) || '/' || p_type || '-#' || p_brand || ' !'"
_NORM = r"trim(regexp_replace(regexp_replace(translate(lower(trim({0})), '_-/', '   '), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("label_normalize", f"""
    SELECT p_partkey, {_NORM.format(_LABEL)} AS label, replace({_NORM.format(_LABEL)}, ' ', '_') AS folder,
      CASE WHEN p_size < 10 THEN 'thank you' ELSE 'thank them' END AS merged FROM part""")
def label_normalize(spark, d):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("/"), "p_type", F.lit("-#"), "p_brand", F.lit(" !"))
    thanks = F.when(F.col("p_size") < 10, "Thank_You").otherwise("Thank--them")
    return table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size").select(
        "p_partkey", text.normalize_label(raw).alias("label"), text.folder_name(raw).alias("folder"),
        text.normalize_label(thanks).alias("merged"),
    )


@query("gloss_normalize", r"""
    SELECT p_partkey,
      trim(regexp_replace(regexp_replace(lower(replace(regexp_replace(regexp_replace(trim(raw), '^\d+\s*[.)]\s*', ''), '\s*\([^)]*\)\s*$', ''), '_', ' ')),
        '[^a-z0-9'' ]+', ' ', 'g'), '\s+', ' ', 'g')) AS gloss,
      trim(regexp_replace(raw, '^\d+\.\s*', '')) AS unindexed,
      regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') AS token,
      trim(regexp_replace(regexp_replace(translate(lower(trim(raw)), '_-', '  '), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain
    FROM (SELECT p_partkey, p_size || '. ' || upper(p_name) || '_' || p_brand || ' (' || p_type || ')' AS raw FROM part)""")
def gloss_normalize(spark, d):
    raw = F.concat(
        F.col("p_size").cast("string"), F.lit(". "), F.upper("p_name"), F.lit("_"), "p_brand", F.lit(" ("), "p_type", F.lit(")")
    )
    return table(spark, d, "part", "p_partkey", "p_size", "p_name", "p_brand", "p_type").select(
        "p_partkey", text.normalize_gloss(raw).alias("gloss"), text.strip_index(raw).alias("unindexed"),
        text.token(raw).alias("token"), text.normalize_plain(raw).alias("plain"),
    )


_GENERIC = ", ".join(f"'{g}'" for g in fixed.GENERIC_FOLDERS)


@query("path_label", rf"""
    WITH p AS (SELECT page_id, replace(replace(regexp_replace(url, '^https?://', ''), '/en/', '/Videos/'), '/fr/', '/user12/') || '.mp4' AS path FROM pages),
    f AS (SELECT *, list_filter(list_reverse(string_split(path, '/')[1:-2]), lambda x: x <> '' AND lower(x) NOT IN ({_GENERIC})
        AND NOT regexp_full_match(lower(x), 'user\d+|isl_data_user\d+'))[1] AS folder,
        string_split(path, '/')[-1] AS name FROM p),
    s AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS stem FROM f)
    SELECT page_id, {_NORM.format("regexp_replace(folder, '^[0-9]+[.][ ]*', '')")} AS label,
      'web_' || regexp_replace(regexp_replace(stem, '[^A-Za-z0-9]+', '_', 'g')[1:40], '^_+|_+$', '', 'g') || '_' || sha1('web/' || path)[1:10] AS clip_key,
      stem || '__T30__' || sha1(array_to_string(string_split(path, '/')[-2:], '/') || '|30|v2')[1:16] || '.npy' AS cache_v2,
      stem || '__T30__' || sha1(path || '|30|v1')[1:16] || '.npy' AS cache_v1 FROM s""")
def path_label(spark, d):
    bare = F.regexp_replace("url", "^https?://", "")
    bare = F.replace(F.replace(bare, F.lit("/en/"), F.lit("/Videos/")), F.lit("/fr/"), F.lit("/user12/"))
    rows = table(spark, d, "pages", "page_id", "url").select("page_id", F.concat(bare, F.lit(".mp4")).alias("path"))
    path = F.col("path")
    return rows.select(
        "page_id", text.label_from_path(path).alias("label"), text.clip_key(F.lit("web"), path).alias("clip_key"),
        text.cache_key(path, 30).alias("cache_v2"), text.cache_key(path, 30, "v1").alias("cache_v1"),
    )


@query("quality_score", """
    SELECT p_partkey, score, score >= 0.35 AS accepted FROM (
      SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 0.0 ELSE CAST(greatest(0.0, 1.0
        - CASE WHEN p_size * 12 < 224 THEN 0.4 WHEN p_size * 12 < 360 THEN 0.15 ELSE 0 END
        - CASE WHEN p_size < 12 THEN 0.3 WHEN p_size < 20 THEN 0.1 ELSE 0 END
        - CASE WHEN p_retailprice / 40 < 0.3 OR p_retailprice / 40 > 30 THEN 0.4 ELSE 0 END
        - CASE WHEN p_size * 6 < 20 OR p_size * 6 > 235 THEN 0.2 ELSE 0 END) AS DOUBLE) END AS score FROM part)""")
def quality_score(spark, d):
    size = F.col("p_size")
    score = clip_sources.quality_score(size * 20, size * 12, size, F.col("p_retailprice") / 40, size * 6, F.col("p_type") != "SMALL")
    rows = table(spark, d, "part", "p_partkey", "p_type", "p_size", "p_retailprice").select("p_partkey", score.alias("score"))
    return rows.withColumn("accepted", F.col("score") >= 0.35)


@query("identity_key", with_views("ident", body="SELECT key, identity FROM ident"))
def identity_key(spark, d):
    return views.identified(spark, d).select("key", "identity")


# CRC-32 bit by bit: xor with the next byte, then eight shifts, each with the reversed polynomial if a 1 falls out
_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)))"""


@query("shard_partition", with_views("clips", body=f"""
    SELECT CAST({_CRC32} % 4 AS INTEGER) AS shard, count(*) AS n FROM clips GROUP BY 1"""))
def shard_partition(spark, d):
    rows = views.clips(spark, d).select(shard_of(F.col("key"), 4).alias("shard"))
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("match_targets", """
    WITH t AS (SELECT p_name AS word, min(p_partkey) AS pos FROM part WHERE p_name LIKE '%ring' OR p_name LIKE 'red%' GROUP BY 1),
    l AS (SELECT p_partkey, CASE WHEN p_size < 15 THEN replace(p_name, ' ', '') ELSE p_name END AS label FROM part)
    SELECT p_partkey, label, coalesce(e.word, s.word) AS target,
      CASE WHEN e.word IS NOT NULL THEN 'exact' WHEN s.word IS NOT NULL THEN 'normalized' ELSE 'no_match' END AS match
    FROM l LEFT JOIN t e ON l.label = e.word
      LEFT JOIN (SELECT replace(word, ' ', '') AS c, arg_min(word, pos) AS word FROM t GROUP BY 1) s ON replace(l.label, ' ', '') = s.c""")
def match_targets(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    targets = part.filter(F.col("p_name").endswith("ring") | F.col("p_name").startswith("red"))
    targets = targets.groupBy(F.col("p_name").alias("word")).agg(F.min("p_partkey").alias("pos"))
    label = F.when(F.col("p_size") < 15, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    rows = part.select("p_partkey", label.alias("label"))
    return joins.match_targets(rows, text.normalize_label(F.col("label")), targets)


@query("align_words", """
    WITH r AS (SELECT upper(replace(p_name, ' ', '_')) AS name, min(p_partkey) AS pos FROM part GROUP BY 1),
    l AS (SELECT DISTINCT p_name AS word FROM part WHERE p_name NOT LIKE 'small%')
    SELECT l.word, r.name, r.pos, l.word IS NOT NULL AS found FROM r LEFT JOIN l
      ON regexp_replace(lower(r.name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(l.word), '[^a-z0-9]+', '', 'g')""")
def align_words(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name")
    asked = part.groupBy(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name")).agg(F.min("p_partkey").alias("pos"))
    labels = part.filter(~F.col("p_name").startswith("small")).select(F.col("p_name").alias("word"))
    return joins.align_words(asked, labels)


@query("unfinished_jobs", """
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def unfinished_jobs(spark, d):
    done = table(spark, d, "lineitem", "l_orderkey", "l_linestatus").filter(F.col("l_linestatus") == "F")
    done = done.select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unfinished(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), done, ["o_orderkey"])


@query("word_sets", """
    WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size > 25), b AS (SELECT DISTINCT p_name FROM part WHERE p_type = 'SMALL')
    SELECT 'both' AS kind, p_name FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'only_first', p_name FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'either', p_name FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def word_sets(spark, d):
    part = table(spark, d, "part", "p_name", "p_size", "p_type")
    a = part.filter(F.col("p_size") > 25).select("p_name").distinct()
    b = part.filter(F.col("p_type") == "SMALL").select("p_name").distinct()
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "p_name")
    return kind(a.intersect(b), "both").unionByName(kind(a.subtract(b), "only_first")).unionByName(kind(a.union(b).distinct(), "either"))


@query("asof_session", with_views("ev", body="""
    SELECT l.event_id, l.user_id, r.start FROM ev l ASOF LEFT JOIN
      (SELECT user_id, event_id AS start FROM ev WHERE event_type = 'signup') r ON l.user_id = r.user_id AND l.event_id >= r.start"""))
def asof_session(spark, d):
    ev = table(spark, d, "events", "event_id", "user_id", "event_type")
    starts = ev.filter(F.col("event_type") == "signup").select("user_id", F.col("event_id").alias("start"))
    return sessions.asof_backward(ev.select("event_id", "user_id"), starts, ["user_id"], "event_id", "start")


@query("gap_sessions", """
    WITH n AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
    g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) AS gap FROM n)
    SELECT user_id, sec, max(CASE WHEN gap IS NULL OR gap > 21600 THEN sec END) OVER (PARTITION BY user_id ORDER BY sec) AS session_start FROM g""")
def gap_sessions(spark, d):
    ev = table(spark, d, "events", "user_id", "ts").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))
    return sessions.gap_sessions(ev, ["user_id"], "sec", 21_600, 86_400)


@query("exact_dups", """
    SELECT CAST(f AS VARCHAR) AS kept, CAST(doc_id AS VARCHAR) AS removed, 'sha256' AS reason, lang AS word FROM (
      SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id <> f""")
def exact_dups(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "text").withColumn("path", F.col("doc_id").cast("string"))
    return dedup.exact_duplicates(docs, F.col("text"), "doc_id", "path", "lang")


@query("drop_exact", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY text")
def drop_exact(spark, d):
    return dedup.drop_exact(table(spark, d, "documents", "doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "sha256")


_STORES = """, stores AS (
    SELECT 0 AS st, * FROM ident WHERE source <> 'dictionary' UNION ALL SELECT 1, * FROM ident)"""


def _stores(spark, d):
    rows = views.clips(spark, d)
    return [rows.filter(F.col("source") != "dictionary").withColumn("store", F.lit(0)), rows.withColumn("store", F.lit(1))]


@query("load_stores", with_views("ident", body=_STORES + """,
    u AS (SELECT *, CASE WHEN source = 'camera' THEN 'camera:' || word || ':' || event_id ELSE source || ':' || key END AS uid
      FROM stores WHERE n_frames > 0),
    keep AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY uid ORDER BY st, key) = 1),
    g AS (SELECT key, event_id AS n, lag(event_id) OVER (ORDER BY event_id) AS p FROM keep WHERE source = 'camera'),
    s AS (SELECT key, max(CASE WHEN p IS NULL OR n - p > 12 THEN n END) OVER (ORDER BY n) AS s FROM g)
    SELECT k.key, k.word, k.source, st AS store, CASE WHEN k.source = 'camera' THEN 'session:camera_s' || s.s ELSE identity END AS identity
    FROM keep k LEFT JOIN s ON k.key = s.key"""))
def load_stores(spark, d):
    stores = [clip_sources.usable(s) for s in _stores(spark, d)]
    rows = clip_sources.load_stores(stores, "camera", views.GAP)
    return rows.select("key", "word", "source", "store", "identity")


@query("merge_stores", with_views("ident", body=_STORES + """
    SELECT key, max(st) AS store, any_value(word) AS word FROM stores GROUP BY key"""))
def merge_stores(spark, d):
    return sinks.merge_stores(_stores(spark, d)).select("key", "store", "word")


@query("upsert_latest", """
    SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), max(o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def upsert_latest(spark, d):
    orders = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    last = lambda df: ranking.take_last(df.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
    new = last(orders.filter(F.col("o_orderstatus") == "F"))
    return sinks.upsert(last(orders), new, "o_custkey")


_HASHES = "h AS (SELECT doc_id, lang, source, CAST(('0b' || array_to_string(list_transform(v, lambda x: CASE WHEN x > list_sum(v) / 64.0 THEN '1' ELSE '0' END), '')) AS VARCHAR) AS b FROM (SELECT doc_id, lang, source, list_transform(string_split('" + views.ALPHABET + "', ''), lambda c: length(text) - length(replace(text, c, ''))) AS v FROM documents))"


@query("near_dup_pairs", f"""
    WITH {_HASHES}, n AS (SELECT DISTINCT lang, source, b FROM h),
    p AS (SELECT x.lang, x.source, CAST(x.b[3:] AS BIT) AS x, CAST(y.b[3:] AS BIT) AS y FROM n x JOIN n y ON x.lang = y.lang AND x.source = y.source AND x.b < y.b)
    SELECT lang, source, CAST(bit_count(xor(x, y)) AS INTEGER) AS distance, count(*) AS n_pairs FROM p WHERE bit_count(xor(x, y)) <= 3 GROUP BY ALL""")
def near_dup_pairs(spark, d):
    hashes = checkpoint(views.document_hashes(spark, d).select("lang", "source", "h").distinct())
    pairs = dedup.near_pairs(hashes, ["lang", "source"], "h")
    return pairs.groupBy("lang", "source", "distance").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("near_dup_greedy", f"""
    WITH RECURSIVE {_HASHES},
    items AS MATERIALIZED (SELECT doc_id, lang, source, CAST(b[3:] AS BIT) AS b, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM h),
    walk AS (SELECT DISTINCT lang, source, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS kept_by,
        CAST([] AS BIGINT[]) AS ids, CAST([] AS BIT[]) AS hs FROM items
      UNION ALL
      SELECT lang, source, rn, d, coalesce(ids[hit], d), CASE WHEN hit IS NULL THEN list_append(ids, d) ELSE ids END,
        CASE WHEN hit IS NULL THEN list_append(hs, b) ELSE hs END FROM (
        SELECT w.lang, w.source, i.rn, i.doc_id AS d, i.b, w.ids, w.hs,
          list_filter(range(1, len(w.hs) + 1), lambda x: bit_count(xor(w.hs[x], i.b)) <= 3)[1] AS hit
        FROM walk w JOIN items i ON i.lang = w.lang AND i.source = w.source AND i.rn = w.rn + 1))
    SELECT doc_id, kept_by, CASE WHEN doc_id <> kept_by THEN 'phash<=3 same signer' END AS reason FROM walk WHERE rn > 0""")
def near_dup_greedy(spark, d):
    rows = dedup.greedy_near_duplicates(views.document_hashes(spark, d), ["lang", "source"], "h", "doc_id")
    kept = F.col("kept_by") == F.col("doc_id")
    return rows.select("doc_id", "kept_by", F.when(~kept, "phash<=3 same signer").alias("reason"))


@query("dedup_log", f"""
    WITH RECURSIVE {_HASHES},
    owned AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents),
    items AS MATERIALIZED (SELECT doc_id, lang, source, CAST(b[3:] AS BIT) AS b, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn
      FROM h JOIN owned USING (doc_id) WHERE doc_id = first_id),
    walk AS (SELECT DISTINCT lang, source, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS kept_by,
        CAST([] AS BIGINT[]) AS ids, CAST([] AS BIT[]) AS hs FROM items
      UNION ALL
      SELECT lang, source, rn, d, coalesce(ids[hit], d), CASE WHEN hit IS NULL THEN list_append(ids, d) ELSE ids END,
        CASE WHEN hit IS NULL THEN list_append(hs, b) ELSE hs END FROM (
        SELECT w.lang, w.source, i.rn, i.doc_id AS d, i.b, w.ids, w.hs,
          list_filter(range(1, len(w.hs) + 1), lambda x: bit_count(xor(w.hs[x], i.b)) <= 3)[1] AS hit
        FROM walk w JOIN items i ON i.lang = w.lang AND i.source = w.source AND i.rn = w.rn + 1))
    SELECT first_id AS kept, doc_id AS removed, 'sha256' AS reason, 'exact_sha_duplicate' AS status FROM owned WHERE doc_id <> first_id
    UNION ALL SELECT kept_by, doc_id, 'phash<=3 same signer', 'near_phash_duplicate' FROM walk WHERE rn > 0 AND doc_id <> kept_by
    UNION ALL SELECT NULL, doc_id, NULL, 'kept' FROM walk WHERE rn > 0 AND doc_id = kept_by""")
def dedup_log(spark, d):
    """Exact and near copies in one pass: what became of every document."""
    texts = table(spark, d, "documents", "doc_id", "text")
    rows = views.document_hashes(spark, d).select("doc_id", "lang", "source", "h").join(texts, "doc_id")
    out = dedup.deduplicate(rows, F.col("text"), ["lang", "source"], "h", "doc_id", "doc_id")
    return out.select("kept", F.col("doc_id").alias("removed"), "reason", "status")


@query("store_fingerprint", with_views("clips", body="""
    SELECT source, count(*) AS n_keys, {print} AS fingerprint FROM clips GROUP BY source""".replace("{print}", views.fingerprint_sql("key"))))
def store_fingerprint(spark, d):
    return key_fingerprint(views.clips(spark, d), ["source"], "key")


@query("store_fingerprint_large", with_views("clips", body="""
    SELECT source, word, count(*) AS n_keys, {print} AS fingerprint FROM clips GROUP BY source, word""".replace("{print}", views.fingerprint_sql("key"))))
def store_fingerprint_large(spark, d):
    return key_fingerprint(views.clips(spark, d), ["source", "word"], "key")


@query("priority_queue", """
    SELECT p_partkey, key, CASE WHEN key LIKE 'PROMO%' THEN 0 WHEN key LIKE 'SMALL%' THEN 1 ELSE 2 END AS rank FROM (
      SELECT p_partkey, p_type || '/' || p_name AS key, p_type FROM part)
    WHERE (key LIKE 'PROMO%' OR key LIKE 'SMALL%' OR key LIKE 'ECONOMY%')
      AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)""")
def priority_queue(spark, d):
    rows = table(spark, d, "part", "p_partkey", "p_type", "p_name").select("p_partkey", F.concat_ws("/", "p_type", "p_name").alias("key"))
    done = table(spark, d, "lineitem", "l_partkey", "l_returnflag", "l_discount")
    done = done.filter((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08))
    todo = joins.unfinished(rows, done.select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])
    ranked = todo.withColumn("rank", joins.priority_rank(F.col("key"), ["PROMO", "SMALL", "ECONOMY"]))
    return ranked.filter(F.col("rank").isNotNull()).orderBy("rank", "key")


@query("archive_status", """
    SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(floor(p_retailprice) AS BIGINT) AS expected,
      CASE WHEN got = CAST(floor(p_retailprice) AS BIGINT) THEN 'OK' ELSE 'HAVE ' || coalesce(got, -1) END AS status
    FROM part LEFT JOIN (SELECT l_partkey, CAST(floor(max(l_extendedprice / l_quantity)) AS BIGINT) AS got FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
      ON p_partkey = l_partkey""")
def archive_status(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_retailprice")
    listing = part.select(F.col("p_partkey").cast("string").alias("key"), F.floor("p_retailprice").alias("size"))
    line = table(spark, d, "lineitem", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag").filter(F.col("l_returnflag") == "A")
    disk = line.groupBy(F.col("l_partkey").cast("string").alias("key")).agg(
        F.floor(F.max(F.col("l_extendedprice") / F.col("l_quantity"))).alias("size")
    )
    return joins.archive_status(listing, disk)


@query("deal_largest_first", """
    SELECT p_partkey, (r - 1) % 4 AS hand, ((r - 1) % 4 - 1 + 4) % 4 AS turn, (r - 1) // 4 AS place FROM (
      SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)""")
def deal_largest_first(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_retailprice")
    ranked = ranking.range_rank(part, [], [F.col("p_retailprice").desc(), F.col("p_partkey")], "r")
    hand = F.pmod(F.col("r") - 1, F.lit(4))
    return ranked.select("p_partkey", hand.alias("hand"), F.pmod(hand - 1, F.lit(4)).alias("turn"), F.floor((F.col("r") - 1) / 4).alias("place"))


@query("json_results", with_views("ev", body="""
    SELECT event_type, k, count(*) AS n, round(avg(value), 9) AS mean_value FROM ev GROUP BY ALL"""))
def json_results(spark, d):
    return views.events(spark, d).groupBy("event_type", "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean_value")
    )


@query("data_manifest", with_views("clips", body="""
    SELECT source AS store, count(DISTINCT user_id % 3) AS n_members, count(DISTINCT fp) AS n_fingerprints FROM (
      SELECT user_id, source, {print} AS fp
      FROM (SELECT DISTINCT user_id % 3 AS user_id, source, license FROM clips) GROUP BY user_id, source) GROUP BY source""".replace("{print}", views.fingerprint_sql("license"))))
def data_manifest(spark, d):
    rows = views.clips(spark, d).select(F.pmod("user_id", F.lit(3)).alias("member"), "source", "license").distinct()
    prints = key_fingerprint(rows, ["member", "source"], "license")
    info = F.struct(F.col("n_keys").alias("n_clips"), F.lit(5).cast("bigint").alias("n_words"), F.col("fingerprint").alias("keys_sha1"))
    docs = prints.groupBy("member").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", info)))).alias("json"))
    return results.store_conflicts(docs)


@query("rescan_records", with_views("ev", body="""
    , t AS (SELECT DISTINCT event_type AS word FROM ev WHERE event_type <> 'error'),
    l AS (SELECT event_id, CASE WHEN k < 50 THEN event_type ELSE 'house' END AS label FROM ev)
    SELECT CAST(event_id AS VARCHAR) || '.mp4' AS original_filename, word, 'accepted' AS review_status FROM l JOIN t ON label = word"""))
def rescan_records(spark, d):
    ev = views.events(spark, d)
    label = F.when(F.col("k") < 50, F.concat(F.lit("7. "), F.initcap("event_type"))).otherwise(F.lit("House"))
    files = ev.select(F.concat(F.lit("root/"), label, F.lit("/user1/"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("path"))
    targets = ev.filter(F.col("event_type") != "error").select(F.col("event_type").alias("word")).distinct().withColumn("pos", F.lit(0))
    rows = listings.rescan(files, targets, "local")
    return rows.select("original_filename", "word", "review_status")


@query("normalization_map", """
    SELECT p_name AS original_label, p_type AS normalized_word, p_brand AS dataset, arg_min(p_size, p_partkey) AS review_status FROM part GROUP BY ALL""")
def normalization_map(spark, d):
    rows = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size").select(
        "p_partkey", F.col("p_name").alias("original_label"), F.col("p_type").alias("normalized_word"),
        F.col("p_brand").alias("dataset"), F.col("p_size").alias("review_status"),
    )
    return reports.normalization_map(rows, "p_partkey")


@query("dictionary_listing", """
    SELECT p_partkey, p_name AS word FROM part WHERE p_size >= 5 AND p_name LIKE '%bolt'""")
def dictionary_listing(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    kind = F.when(F.col("p_size") < 5, F.lit(" (Explaination).mp4")).otherwise(F.lit(" - English.MP4"))
    files = part.select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit("/"), F.initcap("p_name"), kind).alias("path"))
    vocab = part.filter(F.col("p_name").endswith("bolt")).select(F.col("p_name").alias("word")).distinct()
    return listings.dictionary_listing(files, vocab).select("p_partkey", "word")


@query("missing_words", """
    SELECT word FROM (SELECT DISTINCT p_name AS word FROM part) WHERE word NOT IN (SELECT p_name FROM part WHERE p_size < 3 AND p_retailprice < 1500)""")
def missing_words(spark, d):
    part = table(spark, d, "part", "p_name", "p_size", "p_retailprice")
    hits = part.filter((F.col("p_size") < 3) & (F.col("p_retailprice") < 1500)).select(F.col("p_name").alias("word"))
    return listings.missing_words(part.select(F.col("p_name").alias("word")), hits, first=None)


@query("needed_categories", """
    SELECT DISTINCT p_brand AS parent_label FROM part WHERE p_name LIKE 'red %' AND p_size > 40""")
def needed_categories(spark, d):
    part = table(spark, d, "part", "p_name", "p_brand", "p_size")
    label = F.concat(F.col("p_size").cast("string"), F.lit(". "), F.initcap("p_name"))
    meta = part.filter(F.col("p_size") > 40).select(label.alias("label"), F.col("p_brand").alias("parent_label"))
    targets = part.filter(F.col("p_name").startswith("red ")).select(F.col("p_name").alias("word")).distinct()
    return listings.needed_categories(meta, targets)


@query("filename_matches", """
    SELECT p_partkey, p_name AS word FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_type = 'PROMO')""")
def filename_matches(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name", "p_type")
    joined = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    files = part.select(F.concat(F.lit("Videos/"), joined, F.lit("__"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("path"))
    targets = part.filter(F.col("p_type") == "PROMO").select(F.col("p_name").alias("word")).distinct()
    rows = listings.filename_matches(files, targets)
    return rows.select(F.regexp_extract("path", r"__(\d+)", 1).cast("bigint").alias("p_partkey"), "word")


@query("gloss_review", """
    SELECT 'hello' AS target, p_partkey FROM part WHERE p_name = 'red widget'
    UNION ALL SELECT p_name, p_partkey FROM part WHERE p_name LIKE '%ring'""")
def gloss_review(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name")
    rows = part.select("p_partkey", F.initcap("p_name").alias("gloss"))
    names = part.filter(F.col("p_name").endswith("ring")).select(F.col("p_name").alias("word")).distinct()
    targets = names.unionByName(part.agg(F.max(F.lit("hello")).alias("word")))
    matched, review = listings.gloss_matches(rows, targets, {"hello": "red widget"})
    return review.select("target", "p_partkey").unionByName(matched.select(F.col("n").alias("target"), "p_partkey"))


@query("word_sources", """
    SELECT p_name AS word, string_agg(DISTINCT p_type, chr(10) ORDER BY p_type) AS sources FROM part GROUP BY p_name""")
def word_sources(spark, d):
    rows = table(spark, d, "part", "p_name", "p_type").select(F.col("p_name").alias("word"), F.col("p_type").alias("dataset"))
    return reports.word_sources(rows)


@query("manifests", with_views("clips", body="""
    SELECT source, count(*) AS n_clips, count(DISTINCT word) AS n_words, {print} AS keys_sha1 FROM clips GROUP BY source""".replace("{print}", views.fingerprint_sql("key"))))
def manifests(spark, d):
    rows = views.clips(spark, d)
    made = sinks.manifest(rows, key_fingerprint(rows, ["source"], "key"), ["source"], revision="r1")
    return sinks.manifest_matches(made, {"revision": "r1", "words": None}).select("source", "n_clips", "n_words", "keys_sha1")


@query("inventory", with_views("clips", body="""
    SELECT s.source, s.place, count(c.key) AS clips, count(DISTINCT c.word) AS words, count(DISTINCT nullif(trim(c.signer), '')) AS signers, count(c.key) > 0 AS found
    FROM (SELECT DISTINCT source, 'table' AS place FROM clips UNION ALL SELECT 'never seen', 'list') s LEFT JOIN clips c ON c.source = s.source GROUP BY ALL"""))
def inventory(spark, d):
    rows = views.clips(spark, d)
    listed = rows.select("source").distinct().withColumn("place", F.lit("table"))
    never = listed.agg(F.max(F.lit("never seen")).alias("source"), F.max(F.lit("list")).alias("place"))
    return reports.inventory(rows, listed.unionByName(never))


@query("licences", with_views("clips", body="""
    SELECT source, CASE WHEN license = 'licence 0' THEN 'unknown' ELSE license END AS licence, count(*) AS clips, license = 'licence 0' AS needs_review FROM clips GROUP BY ALL"""))
def licences(spark, d):
    rows = views.clips(spark, d)
    return reports.licences(rows.withColumn("license", F.when(F.col("license") == "licence 0", F.lit(" ")).otherwise(F.col("license"))))
