"""Readers, sinks, the inbox stream, images and the classifier."""

import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekha import session
from lekha.functions import codec
from lekha.operators import images, ml
from lekha.plans import corpus
from lekha.sources import frame_store, readers, sinks
from lekha.streaming.inbox import ingest_inbox
from lekha.tables import RUNS


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_verses_keep_key_order(spark, tmp_path):
    path = write(tmp_path / "v.jsonl", json.dumps({"id": 3, "verse": "ಮ", "interpretation2": "b", "interpretation1": "a", "x": 1}))
    row = readers.read_verses(spark, path).first()
    assert row["id"] == 3 and list(row["interpretations"]) == ["interpretation2", "interpretation1"]


def test_jsonl_drops_skipped(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", '{"id": "a"}', '{"id": "b", "skipped": true}', '{"id": "c", "skipped": false}')
    got = readers.read_jsonl(spark, path, T.StructType([T.StructField("id", T.StringType())]))
    assert sorted(r["id"] for r in got.collect()) == ["a", "c"]


def test_fields_are_literal_and_strict_mode_fails(spark, tmp_path):
    path = write(tmp_path / "t.tsv", '1\t"a\tb', "2\tx", "3\t\t")
    got = readers.read_fields(spark, path, ["id", "old", "new"]).orderBy("id").collect()
    assert [(r["id"], r["old"], r["new"]) for r in got] == [("1", '"a', "b"), ("3", "", "")]
    with pytest.raises(Exception, match="3 fields"):
        readers.read_fields(spark, path, ["id", "old", "new"], strict=True).collect()


def test_paired_lines_split_once_after_the_limit(spark, tmp_path):
    path = write(tmp_path / "p.txt", "a\tb\tc", "", "no tab", "d\te")
    got = readers.read_paired_lines(spark, path, limit=2).collect()
    assert [(r["old_text"], r["modern_text"]) for r in got] == [("a", "b\tc")]
    assert readers.read_paired_lines(spark, path).count() == 2


def test_file_pos_orders_a_file_read_in_splits(spark, tmp_path):
    path = write(tmp_path / "big.txt", *[f"{i:06}" for i in range(20000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = readers._lines(spark, path)
        assert lines.rdd.getNumPartitions() > 1
        assert [r["value"] for r in lines.orderBy("file_pos").collect()] == [f"{i:06}" for i in range(20000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gold_folder(spark, tmp_path):
    docs = {"a": {"crop": "x", "text": "\n old "}, "b": {"data": {"crop": "x", "text": "é  new"}},
            "c": {"crop": "y", "text": "t", "illegible": True}, "d": {"crop": "z", "text": "  "}}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1), encoding="utf-8")
    assert [tuple(r) for r in readers.read_gold_dir(spark, str(tmp_path)).collect()] == [("x", "é new")]


def test_label_files_last_row_wins(spark, tmp_path):
    write(tmp_path / "labels_m.x.jsonl", '{"crop": "a", "text": "1"}', '{"crop": "a", "text": "2"}', '{"crop": "a", "error": "e"}')
    write(tmp_path / "labels_bad.jsonl", '{"crop": "a", "error": "e"}')
    schema = T.StructType([T.StructField("crop", T.StringType()), T.StructField("text", T.StringType())])
    got = readers.read_label_files(spark, f"{tmp_path}/labels_*.jsonl", schema).collect()
    assert [tuple(r) for r in got] == [("m.x", "a", "2")]


def test_image_listing(spark, tmp_path):
    for name in ("a.JPG", "b/c.tiff", "b/d.txt", "ground_truth_x/e.png"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"x")
    got = readers.list_images(spark, str(tmp_path)).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == ["a.JPG", "c.tiff"]


def test_run_registry_refuses_a_second_write(spark, tmp_path):
    run = spark.createDataFrame([("n", None, "{}", '{"x": 1}')], T.StructType(RUNS.fields[1:]))
    sinks.record_run(run, str(tmp_path / "runs"), "r1")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.record_run(run, str(tmp_path / "runs"), "r1")
    assert sinks.read_runs(spark, str(tmp_path / "runs")).first()["run_id"] == "r1"


def test_cache_keys(spark):
    import hashlib

    row = spark.createDataFrame([("ಮ", "p")], "t string, s string")
    settings = frame_store.settings_json({"b": F.col("s"), "a": F.lit("1")})
    got = frame_store.with_cache_key(row, [F.col("t"), settings]).first()["cache_key"]
    assert got == hashlib.sha256(("ಮ" + json.dumps({"a": "1", "b": "p"}, sort_keys=True)).encode()).hexdigest()[:24]
    prompt = frame_store.with_cache_key(row, [F.lit("model"), F.col("t")], length=32, separator="\x00").first()["cache_key"]
    assert prompt == hashlib.sha256("model\x00ಮ".encode()).hexdigest()[:32]


def test_frame_faults(spark):
    frames = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, 0)], "line_id long, frame int")
    lines = spark.createDataFrame([(1, 2), (2, 2), (4, 1)], "line_id long, n_frames int")
    faults = frame_store.frame_count_faults(frames, lines)
    assert sorted(r["line_id"] for r in faults.collect()) == [2, 3, 4]


def test_inbox_takes_each_key_once_across_restarts(spark, tmp_path):
    box, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = T.StructType([T.StructField("crop", T.StringType()), T.StructField("text", T.StringType())])
    rows = [[("a", "1"), ("b", "1")], [("b", "2"), ("c", "2")]]
    for part in rows:
        spark.createDataFrame(part, schema).write.mode("append").json(box)
        ingest_inbox(spark, box, schema, ["crop"], out, state).awaitTermination()
    ingest_inbox(spark, box, schema, ["crop"], out, state).awaitTermination()
    got = spark.read.parquet(out).select("crop", "text").collect()
    assert sorted(map(tuple, got)) == [("a", "1"), ("b", "1"), ("c", "2")]
    # What has landed is not needed to go on: the stream remembers its keys itself.
    for landed in (tmp_path / "out").glob("part-*"):
        landed.unlink()
    spark.createDataFrame([("a", "3"), ("d", "3"), (None, "3"), (None, "3")], schema).write.mode("append").json(box)
    ingest_inbox(spark, box, schema, ["crop"], out, state).awaitTermination()
    fresh = spark.read.schema(schema).parquet(*map(str, (tmp_path / "out").glob("part-*")))
    assert sorted(map(tuple, fresh.collect()), key=str) == [("d", "3"), (None, "3")]


def test_checksum_of_a_file_larger_than_a_cell(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in/abc").write_bytes(b"abc")
    size = (1 << 31) + 12345  # more than a binary column can hold
    with (tmp_path / "in/large file").open("wb") as out:
        out.truncate(size)
    want = hashlib.sha256()
    for left in range(size, 0, -(1 << 24)):
        want.update(bytes(min(left, 1 << 24)))
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in frame_store.file_checksums(spark, str(tmp_path / "in")).collect()}
    assert got == {"abc": (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), "large file": (size, want.hexdigest())}


def test_lookup_leaves_the_cache_where_it_is(spark, tmp_path):
    schema = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("answer", T.StringType())])
    name = frame_store.attach_cache(spark, str(tmp_path / "cache"), schema, buckets=5)
    rows = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), F.col("id").cast("string").alias("answer"))
    for part in (rows.where("answer < 20"), rows.where("answer between 20 and 29")):
        frame_store.add_to_cache(part, name, buckets=5)
    asked = rows.select("cache_key").where("hex(cache_key) > '3'")
    for how in ("inner", "left", "left_anti"):
        found = frame_store.look_up(asked, name, buckets=5, how=how)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert frame_store.look_up(rows, name, buckets=5).count() + frame_store.look_up(rows, name, buckets=5, how="left_anti").count() == 50


def test_image_tree(spark, tmp_path):
    names = ["a/x.jpg", "a/b/y.PNG", "a/b/z.txt", "ground_truth_1/w.tif", "v.tiff"]
    files = spark.createDataFrame([(n, b"1") for n in names] + [("empty.jpg", None)], "path string, content binary")
    assert sinks.write_files(files, str(tmp_path / "tree")) == 6
    found = readers.list_images(spark, str(tmp_path / "tree"))
    assert sorted(r["path"].split("/tree/")[1] for r in found.collect()) == ["a/b/y.PNG", "a/x.jpg", "v.tiff"]


def test_image_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Same rows as Spark's file source, without a scan that plans a split for every file."""
    monkeypatch.setattr(readers, "_AT_ONCE", 7, raising=False)
    names = [f"a/b{n % 3}/c d/{n}{s}.jpg" for n in range(20) for s in ("", "#1", "%20", "ü")] + [
        "_metadata.png", "_metadata1/w.jpg", "_x.jpg", ".y.jpg", "_t/z.jpg", "_k=1/z.jpg", ".h/z.jpg", "a/u._COPYING_", "q/ground_truth/x.jpg", "e.txt"]
    sinks.write_files(spark.createDataFrame([(n, b"12") for n in names] + [("a/none.jpg", b"")], "path string, content binary"), str(tmp_path / "tree"))
    (tmp_path / "tree" / "bare").mkdir()
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "tree"))
    want = readers.image_paths(source.select("path", "length", "modificationTime"))
    for root in (str(tmp_path / "tree"), f"file://{tmp_path}/tree/", f"file:{tmp_path}/tree"):
        found = readers.list_images(spark, root)
        assert found.rdd.getNumPartitions() < 20 and found.schema == want.schema
        assert sorted(found.collect()) == sorted(want.collect()) and found.count() == 82
    assert readers.list_images(spark, str(tmp_path / "tree/a/b0/*/0.jpg")).count() == 1
    assert readers.list_images(spark, str(tmp_path / "tree/bare")).count() == 0


def test_width_faults(spark):
    lines = spark.createDataFrame([(1, 4, 32), (2, 4, 39), (3, 4, 40), (4, 1, 5), (5, 2, None)], "line_id long, n_frames int, width int")
    assert sorted(r["line_id"] for r in frame_store.width_faults(lines).collect()) == [3, 5]


def bitmap(path, grey):
    h, w = grey.shape
    rows = b"".join(bytes(v for x in r for v in (x, x, x)) + b"\0" * (-3 * w % 4) for r in grey[::-1])
    head = struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0)
    path.write_bytes(b"BM" + head + rows)


def test_image_quality(spark, tmp_path):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (9, 12)).astype(np.uint8)
    bitmap(tmp_path / "a.bmp", grey)
    (tmp_path / "b.bmp").write_bytes(b"no image")
    loaded = spark.read.format("image").option("dropInvalid", False).load(str(tmp_path)).select("image.*")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.image_quality(loaded).collect()}
    g = grey.astype(float)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    assert got["a.bmp"]["sharpness"] == pytest.approx(lap.var()) and got["a.bmp"]["contrast"] == pytest.approx(g.std())
    assert got["a.bmp"]["brightness"] == pytest.approx(g.mean()) and got["a.bmp"]["ink_density"] == pytest.approx((g < 128).mean())
    survey = {r["path"].rsplit("/", 1)[1]: r["heuristic_bucket"] for r in images.survey_table(images.image_quality(loaded)).collect()}
    assert survey == {"a.bmp": "good", "b.bmp": "broken"}


def test_images_with_null_or_wrong_sizes_keep_nulls(spark):
    rows = [("a", 1, 2, 1, b"\x00\xff"), ("b", None, 2, 1, b"\x00\xff"), ("c", 1, None, 1, b"1"), ("d", 2, 2, 1, b"1"), ("e", 1, 1, 3, None)]
    got = images.image_quality(spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, data binary")).collect()
    assert {r["path"]: r["brightness"] for r in got} == {"a": 127.5, "b": None, "c": None, "d": None, "e": None}
    assert [r["width"] for r in got if r["path"] == "a"] == [2]


def test_classifier_learns_a_separable_rule(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("label"), (F.col("id") % 2 * 3 + F.col("id") % 5 / 10).alias("x"),
                                 (F.col("id") % 7).alias("y"), (F.col("id") % 10 == 0).alias("is_test"))
    for r in ml.accuracy_report(df, ["x", "y"], "label", "is_test").collect():
        assert r["accuracy"] == 1.0 and r["in_target"] is False


def test_corpus_builds(spark):
    verses = spark.sql("""SELECT * FROM VALUES
        (1L, 'ಮನೆ, ಮರ|', map('interpretation1', 'ಒಂದು ಎರಡು ಮೂರು ನಾಲ್ಕು. ಬೇರೆ', 'interpretation2', ' ಒಂದು  ಎರಡು ')),
        (2L, 'abc', map('interpretation1', 'ಒಂದು')), (3L, 'ಕ್ಅ', map('interpretation1', 'ಒಂದು')),
        (4L, 'ಮರ', map()) AS t(id, verse, interpretations)""")
    assert {r["text"] for r in corpus.old_lines(verses).collect()} == {"ಮನೆ ಮರ।", "ಮರ"}
    assert [tuple(r) for r in corpus.verse_pairs(verses).collect()] == [(1, "ಮನೆ ಮರ।", "ಒಂದು ಎರಡು")]
    assert [tuple(r) for r in corpus.rule_pairs(verses, rate=0.0).collect()] == [
        ("ಒನ್ದು ಎರಡು ಮೂರು ನಾಲ್ಕು", "ಒಂದು ಎರಡು ಮೂರು ನಾಲ್ಕು")]
    fates = {r["fate"]: r["n"] for r in corpus.corpus_funnel(verses).collect()}
    assert fates == {"kept": 2, "empty": 1, "ambiguous": 1}
    assert codec.KANNADA.virama == "್"


def test_readings_of_unusable_verses_are_not_cleaned(spark, monkeypatch):
    def strict(reading):
        return F.when(reading.contains("never"), F.raise_error(F.lit("a reading was cleaned for nothing")).cast("string")).otherwise(reading)

    monkeypatch.setattr(corpus.text, "clean_modern", strict)
    verses = spark.createDataFrame([(1, "ಮನೆ", {"i": "ಒಂದು"}), (2, "ಮ" * 701, {"i": "never"}), (3, "ಕ್ಅ", {"i": "never"})],
                                   "id long, verse string, interpretations map<string,string>")
    assert [tuple(r) for r in corpus.verse_pairs(verses).collect()] == [(1, "ಮನೆ", "ಒಂದು")]


def test_stored_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffles()
    kept = session.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    deadline = time.time() + 10
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffles() - before
    assert kept.count() == 7 and spark.conf.get(session.CLEANUP, None) is None
    spark.conf.set(session.CLEANUP, "false")
    session.stored(spark.range(3), "few")
    assert spark.conf.get(session.CLEANUP) == "false"
    spark.conf.unset(session.CLEANUP)
