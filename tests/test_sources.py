"""Readers, listings, tables and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from glossloom import fixed
from glossloom.plans import streams
from glossloom.sources import clips, landmarks, listings, results, sinks
from glossloom.streaming import incremental


def make_index(spark, rows):
    return spark.createDataFrame(rows, "key string, word string, source string, signer string, session string, n_frames string, video_rel string, path string")


def test_index_round_trip(spark, tmp_path):
    rows = [("k1", "1. Hello", "include", "", "", "12", "a/MVI_1.mp4", "npy/k1"), ("k2", "NA", "isl500", "User1", "", "bad", "b.mp4", "npy/k2"), ("k3", "NA", "isl500", "User1", "", "7.0", "b.mp4", "npy/k3")]
    store = str(tmp_path / "store")
    sinks.write_csv(sinks.index_rows(make_index(spark, rows)), f"{store}/index.csv")
    got = {r.key: (r.word, r.n_frames, r.abs_path, r.license) for r in clips.read_index(spark, store).collect()}
    assert got == {"k1": ("1. Hello", 12, f"{store}/npy/k1", ""), "k3": ("NA", 7, f"{store}/npy/k3", "")}
    (tmp_path / "store" / "store.json").write_text(json.dumps({"layout": "other"}))
    with pytest.raises(ValueError):
        clips.read_index(spark, store, clips.read_layout(spark, store))


def test_load_stores_removes_the_copy(spark):
    a = [(f"a{n}", "hello", "include", "", "", "10", f"g/MVI_{n}.mp4", "p") for n in (1000, 1001, 3000, 3001, 6000, 6001)]
    b = [("b1", "1. Hello", "include", "", "", "10", "x/MVI_1000.mp4", "p"), ("b2", "1. Hello", "include", "", "", "10", "x/MVI_6005.mp4", "p")]
    out = clips.load_stores([clips.usable(make_index(spark, a)), clips.usable(make_index(spark, b))]).collect()
    assert {r.key for r in out} == {"a1000", "a1001", "a3000", "a3001", "a6000", "a6001", "b2"}
    assert {r.identity for r in out} == {f"session:include_s{n}" for n in (1000, 3000, 6000)}
    words = clips.load_stores([clips.usable(make_index(spark, a))], words=["other"])
    assert words.count() == 0


def test_corpus_projection(spark):
    rows = [("c/ISL_DATASET/eat/session4_a.mp4", "eat", "ISL500", "User01", "x"), ("a.mp4", "go", "ISLRTC-dict", "someone", "x"), ("b.mp4", "go", "CISLR", "team_a", "x"), ("d.mp4", "go", "CISLR", "cat", "x")]
    df = spark.createDataFrame(rows, "video_path string, word string, dataset string, signer string, license string")
    got = [(r.video_rel, r.source, r.signer, r.session) for r in clips.corpus_to_clips(df).collect()]
    assert got == [("eat/session4_a.mp4", "isl500", "User01", "isl500_s4"), ("a.mp4", "islrtc-dict", "islrtc", ""), ("b.mp4", "cislr", "team_a", ""), ("d.mp4", "cislr", "", "")]


def test_file_tree(spark, tmp_path):
    for rel in ("1. Hello/a.MP4", "1. Hello/note.txt", "__MACOSX/1. Hello/a.mp4", "root.mp4", "x/House/b.mov"):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"abc")
    files = listings.list_files(spark, str(tmp_path))
    assert {(r.rel, r.word, r.size) for r in listings.labelled_videos(files).collect()} == {("1. Hello/a.MP4", "1. Hello", 3), ("x/House/b.mov", "House", 3)}
    wanted = spark.createDataFrame([("House", "home")], "label string, word string")
    assert [(r.label, r.word) for r in listings.relabelled(files, wanted).collect()] == [("house", "home")]


def test_dictionary_listing(spark):
    files = spark.createDataFrame([("A/Apple - English.mp4",), ("A/Apple (Explaination).mp4",), ("B/Ball.mp4",), ("B/Ball.txt",)], "path string")
    vocab = spark.createDataFrame([("apple",), ("dog",)], "word string")
    hits = listings.dictionary_listing(files, vocab)
    assert [r.word for r in hits.collect()] == ["apple"]
    assert [r.word for r in listings.missing_words(vocab, hits).collect()] == ["dog"]
    assert listings.dictionary_listing(files, limit=1).count() == 1


def test_column_roles(spark):
    df = spark.createDataFrame([(1, "x/v1.mp4", "eat"), (2, "v2.mp4", "go"), (3, "zz.mp4", "no")], "id int, file string, gloss_name string")
    stems = spark.createDataFrame([("v1",), ("v2",)], "stem string")
    assert listings.infer_columns(df, stems) == ("file", "gloss_name")


def test_gloss_matches_and_review(spark):
    rows = spark.createDataFrame([("Eat", "u1"), ("Namaste", "u2")], "gloss string, uid string")
    targets = spark.createDataFrame([("eat",), ("hello",)], "word string")
    matched, review = listings.gloss_matches(rows, targets, {"hello": "namaste"})
    assert [r.uid for r in matched.collect()] == ["u1"]
    assert [(r.target, r.uid) for r in review.collect()] == [("hello", "u2")]


def test_filename_matches_and_categories(spark):
    files = spark.createDataFrame([("Videos/ThankYou__s1.mp4",), ("Videos/eat_1.mp4",), ("Videos/eaten_1.mp4",)], "path string")
    targets = spark.createDataFrame([("thank you",), ("eat",)], "word string")
    got = {(r.word, r.path) for r in listings.filename_matches(files, targets).collect()}
    assert got == {("thank you", "Videos/ThankYou__s1.mp4"), ("eat", "Videos/eat_1.mp4")}
    meta = spark.createDataFrame([("48. Eat", "Food"), ("1. Dog", "Animals")], "label string, parent_label string")
    assert [r.parent_label for r in listings.needed_categories(meta, targets).collect()] == ["Food"]


def test_rescan_bridges_need_review(spark):
    files = spark.createDataFrame([("r/House/a.mp4",), ("r/eat/b.mp4",), ("r/dog/c.mp4",)], "path string")
    targets = spark.createDataFrame([("home", 0), ("eat", 1)], "word string, pos int")
    got = {(r.word, r.review_status) for r in listings.rescan(files, targets, "x").collect()}
    assert got == {("home", "Needs Manual Review"), ("eat", "accepted")}


def test_target_words(spark):
    df = spark.createDataFrame([(["Thank_You", "eat", "thank you", ""],)], "words array<string>")
    assert [(r.word, r.pos) for r in clips.target_words(df).orderBy("pos").collect()] == [("thank you", 0), ("eat", 1)]


def long_rows(drop=None):
    rows, at = [], 0
    for kind, size in landmarks.FILE_PARTS:
        for i in range(size):
            if at != drop:
                rows.append(("s", 0, kind, i, float(at), 0.0, None))
            at += 1
    return rows


def test_dense_frames(spark):
    schema = "seq string, frame int, type string, landmark_index int, x double, y double, z double"
    good, bad = landmarks.dense_frames(spark.createDataFrame(long_rows(), schema))
    pts = good.first().points
    assert len(pts) == fixed.N_POINTS and bad.count() == 0
    assert (pts[0].x, pts[33].x, pts[54].x, pts[75].x) == (489.0, 468.0, 522.0, 0.0)
    good, bad = landmarks.dense_frames(spark.createDataFrame(long_rows(drop=5), schema))
    assert good.count() == 0 and bad.first().n == fixed.N_POINTS - 1


def test_competition_index(spark):
    meta = spark.createDataFrame([("a.parquet", 7, 1, "dog"), ("b.parquet", 8, 2, "cat")], "path string, participant_id int, sequence_id int, sign string")
    frames = spark.createDataFrame([("a.parquet", 0), ("a.parquet", 1), ("b.parquet", 0)], "seq string, frame int")
    signs = spark.createDataFrame([("dog",)], "sign string")
    row = landmarks.competition_index(meta, frames, signs).first()
    assert (row.word, row.signer, row.n_frames) == ("dog", "asl7", 2) and row.key.startswith("gislr_1_")


def test_results_newest_and_corrupt(spark, tmp_path):
    import os

    for name, body, when in (("r1", {"run": "a", "shots": 4, "metrics": {"top1": 0.5}}, 100), ("r2", {"run": "a", "shots": 4, "metrics": {"top1": 0.7}}, 200), ("r3", {"run": "b", "metrics": {"top1": float("nan")}}, 100)):
        (tmp_path / name).mkdir()
        path = tmp_path / name / "result.json"
        path.write_text(json.dumps(body))
        os.utime(path, (when, when))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "result.json").write_text("{broken")
    got = {r.run: (r.k, r.top1) for r in results.read_results(spark, str(tmp_path)).collect()}
    assert got["a"] == (4, 0.7) and got["b"][0] == -1 and got["b"][1] != got["b"][1] and len(got) == 2


def test_manifest_conflicts(spark):
    good = {"n_clips": 1, "n_words": 1, "keys_sha1": "x"}
    docs = [("m1", json.dumps({"s": good, "t": good})), ("m2", json.dumps({"s": good, "t": {**good, "keys_sha1": "y"}}))]
    got = {r.store: r.n_fingerprints for r in results.store_conflicts(spark.createDataFrame(docs, "member string, json string")).collect()}
    assert got == {"s": 1, "t": 2}


def test_manifest_match_ignores_null_options(spark):
    df = spark.createDataFrame([("s", "r1", ["a", "b"])], "store string, revision string, words array<string>")
    assert sinks.manifest_matches(df, {"revision": "r1", "words": ["a", "b"], "other": None}).count() == 1
    assert sinks.manifest_matches(df, {"words": ["b", "a"]}).count() == 0


def test_gather_fewshot(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = results.gather_fewshot(
        t([("m1",), ("m2",)], "model string"),
        t([("m1", None, [("e1",)]), ("m2", None, [(None,), ("boom",)])], "model string, error string, draws array<struct<error:string>>"),
        t([("m1", 0.6, None)], "model string, test_acc double, val_test_gap double"),
        t([], "model string, meta_best_val_acc double"),
        t([("m1", [(0.5,), (0.9,)])], "model string, epochs array<struct<val_acc:double>>"),
    )
    rows = {r.model: r for r in out.collect()}
    assert rows["m1"].best_val_acc == 0.9 and rows["m1"].val_test_gap == pytest.approx(0.3) and rows["m1"].error is None
    assert rows["m2"].error == "boom" and rows["m2"].epochs_ran is None


def test_append_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "index")
    df = spark.createDataFrame([("k1", "old"), ("k2", "x")], "key string, word string")
    for _ in range(2):
        sinks.append_batch(df, table, 0)
    sinks.append_batch(spark.createDataFrame([("k1", "new")], "key string, word string"), table, 1)
    assert {(r.key, r.word) for r in sinks.read_latest(spark, table).collect()} == {("k1", "new"), ("k2", "x")}


def test_watch_files(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.zip").write_bytes(b"12345")
    (inbox / "b.zip").write_bytes(b"1")
    expected = spark.createDataFrame([("a.zip", 5), ("b.zip", 5)], "key string, size long")
    good, bad, state = (str(tmp_path / n) for n in ("good", "bad", "state"))
    incremental.watch_files(spark, str(inbox), expected, good, bad, state).awaitTermination()
    assert [r.key for r in spark.read.parquet(good).collect()] == ["a.zip"] and [r.key for r in spark.read.parquet(bad).collect()] == ["b.zip"]


def test_stream_dedup_over_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "id long, text string"
    ledger, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    for rows in ([(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = incremental.read_stream(spark, src, schema)
        incremental.stream_dedup(stream, F.col("text"), "id", ledger, state).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(ledger).collect()) == [1, 3, 5]


def test_stream_dedup_keeps_the_least_id_whatever_the_order_of_files(spark, tmp_path):
    src, ledger, state = (str(tmp_path / n) for n in ("src", "ledger", "state"))
    for rows in ([(4, "a"), (5, None)], [(1, "a"), (2, None), (6, "b")], [(3, "a"), (7, "b")]):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(src)
        stream = incremental.read_stream(spark, src, "id long, text string")
        incremental.stream_dedup(stream, F.col("text"), "id", ledger, state).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(ledger).collect()) == [1, 2, 4, 5, 6]


def test_streams_read_tables_of_several_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in streams.stream_dedup(spark, str(tmp_path)).collect()) == [1, 3, 5]


def test_failed_items_are_split(spark):
    df = spark.createDataFrame([("a", None), ("b", "boom")], "path string, error string")
    good, bad = sinks.split_good_and_failed(df)
    assert [r.path for r in good.collect()] == ["a"] and [(r.path, r.error) for r in bad.collect()] == [("b", "boom")]
