"""Cleaning, codec and scalar queries (sections A and B of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import charvocab, codec, nfc, spelling, text, translit
from ..functions.expr import once, words
from ..operators import dedupe, splits
from ..session import shared_dir
from ..sources import frame_store, readers, sinks
from . import corpus
from .adapters import coded, frames, kannada, label_rows, packed, pairs, photos, spread, table, with_views
from .registry import query
from .script_sql import clean_sql

# ---- A: scans, sinks, stores ----------------------------------------------


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as verses with three interpretations each, via JSONL files."""
    docs = table(spark, sf_dir, "documents")
    record = F.to_json(F.struct(
        F.col("doc_id").alias("id"), F.col("text").alias("verse"), F.col("text").alias("interpretation1"),
        F.concat_ws(" ", "lang", "source").alias("interpretation2"),
        F.concat_ws(" ", "source", "lang").alias("interpretation3"), F.col("lang").alias("language")))
    path = shared_dir(spark, "verses")
    docs.select(record.alias("value")).write.text(path)
    return readers.read_verses(spark, path)


_SHORTEST = """CASE WHEN len(regexp_extract_all(text, '\\S+')) < 2 THEN text
               WHEN len(regexp_extract_all(text, '\\S+')) = 2 THEN text ELSE lang || ' ' || source END"""


@query("a1_verse_scan", """
    SELECT doc_id AS id, length(text) AS verse_chars, 3 AS n_interpretations FROM documents""")
def a1(spark, sf_dir):
    return verses(spark, sf_dir).select(
        "id", F.char_length("verse").alias("verse_chars"), F.size("interpretations").alias("n_interpretations"))


@query("a2_known_schema_scan", "SELECT doc_id AS id, text FROM documents WHERE lang <> 'es'")
def a2(spark, sf_dir):
    path = shared_dir(spark, "manifest")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.when(F.col("lang") == "es", True).alias("skipped"))
    sinks.write_jsonl(rows, path)
    return readers.read_jsonl(spark, path, T.StructType([
        T.StructField("id", T.LongType()), T.StructField("text", T.StringType())]))


@query("a3_field_scan", """
    SELECT doc_id::VARCHAR AS doc_id, lang, replace(text, chr(10), ' ') AS text FROM documents WHERE lang <> 'de'""")
def a3(spark, sf_dir):
    path = shared_dir(spark, "fields")
    line = F.when(F.col("lang") == "de", F.concat_ws("\t", "doc_id", "lang")).otherwise(
        F.concat_ws("\t", "doc_id", "lang", F.translate("text", "\n", " ")))
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return readers.read_fields(spark, path, ["doc_id", "lang", "text"]).drop("file_pos")


@query("a4_paired_lines", with_views("""
    SELECT replace(old_text, chr(10), ' ') AS old_text, replace(modern_text, chr(10), chr(9)) AS modern_text
    FROM pairs""", "pairs"))
def a4(spark, sf_dir):
    path = shared_dir(spark, "paired")
    line = F.concat(F.translate("old_text", "\n", " "), F.lit("\t"), F.translate("modern_text", "\n", "\t"))
    rows = pairs(spark, sf_dir)
    rows.select(F.explode(F.array(line, F.lit("   "))).alias("value")).write.text(path)
    return readers.read_paired_lines(spark, path).drop("file_pos")


@query("a5_id_list", """
    SELECT id, count(*) AS n FROM (
      SELECT doc_id AS id FROM documents UNION ALL SELECT n_chars FROM documents) GROUP BY id""")
def a5(spark, sf_dir):
    path = shared_dir(spark, "ids")
    table(spark, sf_dir, "documents").select(F.concat_ws("  ", "doc_id", "n_chars").alias("value")).write.text(path)
    return readers.read_ids(spark, path, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("a6_survey_csv", with_views("""
    SELECT path, coalesce(width, -1) AS width, height, sharpness FROM photos""", "photos"))
def a6(spark, sf_dir):
    path = shared_dir(spark, "survey")
    out = photos(spark, sf_dir).select(
        F.replace("path", F.lit("/"), F.lit("\\")).alias("path"), "width", "height", "sharpness")
    sinks.write_csv(out, path)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("width", T.IntegerType()),
                           T.StructField("height", T.IntegerType()), T.StructField("sharpness", T.DoubleType())])
    rows = readers.read_survey_csv(spark, path, schema)
    return rows.select("path", F.coalesce("width", F.lit(-1)).alias("width"), "height", "sharpness")


@query("a7_gold_directory", """
    SELECT 'c' || item_id AS crop, text FROM (
      SELECT item_id, trim(regexp_replace('v' || v || ' ' || text, '\\s+', ' ', 'g')) AS text, v FROM benchmark, range(3) r(v))
    WHERE v = CASE WHEN text LIKE '%the%' THEN 1 ELSE 2 END""")
def a7(spark, sf_dir):
    """Three versions per passage in one-document files; the last is illegible for some."""
    path = shared_dir(spark, "gold")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("v"), "text")
    body = F.struct(
        F.concat(F.lit("c"), "item_id").alias("crop"), F.concat(F.lit("\n v"), "v", F.lit("  "), "text").alias("text"),
        ((F.col("v") == 2) & F.col("text").contains("the")).alias("illegible"))
    doc = F.when(F.col("v") == 1, F.to_json(F.struct(body.alias("data")))).otherwise(F.to_json(body))
    named = rows.select(doc.alias("value"), F.concat_ws("-", F.lpad(F.col("item_id").cast("string"), 19, "0"), "v").alias("doc"))
    named.repartition("doc").write.partitionBy("doc").text(path)
    return readers.read_gold_dir(spark, f"{path}/*/*").select("crop", "text")


@query("a8_label_files", with_views("""
    SELECT labeller, crop, text || ' again' AS text FROM label_rows""", "label_rows"))
def a8(spark, sf_dir):
    """Two attempts per crop in each labeller's files; the later one counts."""
    base = shared_dir(spark, "labels")
    tries = label_rows(spark, sf_dir).select(
        "labeller", "crop", F.explode(F.array(
            F.struct(F.lit(0).alias("attempt"), F.col("text").alias("text")),
            F.struct(F.lit(1).alias("attempt"), F.concat("text", F.lit(" again")).alias("text")),
            F.struct(F.lit(2).alias("attempt"), F.lit(None).cast("string").alias("text")))).alias("x")).select("labeller", "crop", "x.*")
    for name in ("alpha", "beta", "gamma"):
        one = tries.where(F.col("labeller") == name).repartitionByRange("crop").sortWithinPartitions("crop", "attempt")
        sinks.write_jsonl(one.select("crop", "text"), f"{base}/labels_{name}.jsonl")
    schema = T.StructType([T.StructField("crop", T.StringType()), T.StructField("text", T.StringType())])
    return readers.read_label_files(spark, f"{base}/labels_*.jsonl", schema)


@query("a9_image_paths", with_views("""
    SELECT path FROM photos WHERE lang <> 'de' AND lang <> 'es'""", "photos"))
def a9(spark, sf_dir):
    stem = F.regexp_replace("path", r"\.jpg$", "")
    suffix = F.when(F.col("lang") == "es", ".txt").otherwise(".jpg")
    folder = F.when(F.col("lang") == "de", "set/ground_truth_v2/").otherwise("")
    named = photos(spark, sf_dir).select(F.concat(folder, stem, suffix).alias("path"))
    return readers.image_paths(named)


@query("a9_image_tree", with_views("""
    SELECT DISTINCT CASE WHEN lang = 'de' THEN 'set/ground_truth_v2/' ELSE '' END || path AS path FROM photos WHERE lang <> 'de'""", "photos"))
def a9_tree(spark, sf_dir):
    """A folder tree of images and other files is written, then listed without reading any content."""
    root = shared_dir(spark, "tree")
    folder = F.when(F.col("lang") == "de", "set/ground_truth_v2/").otherwise("")
    named = photos(spark, sf_dir).select(F.concat(folder, "path").alias("path"), "file_pos")
    files = named.unionAll(named.select(F.concat("path", F.lit(".txt")), "file_pos"))
    sinks.write_files(files.select("path", F.encode(F.col("file_pos").cast("string"), "UTF-8").alias("content")), root)
    found = readers.list_images(spark, root)
    return found.select(F.regexp_extract("path", "tree-[0-9a-f]+/(.*)$", 1).alias("path"))


@query("a10_review_sheet", """
    SELECT role AS tag, count(*) AS n, count(*) FILTER (WHERE len(text) = 0) AS n_empty, count(*) AS n_open FROM conversations GROUP BY role""")
def a10_review(spark, sf_dir):
    """Tokens go out as a sheet to be filled in and come back with its two empty columns."""
    path = shared_dir(spark, "review")
    tokens = table(spark, sf_dir, "conversations").select(
        F.concat_ws(".", "conv_id", "turn").alias("sentence_id"), F.translate("text", "\t\n", "  ").alias("token"), F.col("role").alias("tag"))
    sinks.write_review_sheet(tokens, path)
    sheet = sinks.read_review_sheet(spark, path)
    open_ = (F.col("correct") == "") & (F.col("corrected_tag") == "")
    return sheet.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("token") == "").alias("n_empty"), F.count_if(open_).alias("n_open"))


@query("a10_sink_round_trip", """
    SELECT f AS format, count(*) AS n, sum(length(text)) AS chars
    FROM (SELECT replace(text, chr(10), ' ') AS text FROM documents), (VALUES ('csv'), ('fields'), ('jsonl'), ('text')) v(f)
    GROUP BY f""")
def a10(spark, sf_dir):
    base = shared_dir(spark, "sinks")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\n", " ").alias("text"))
    sinks.write_lines(rows, "text", f"{base}/text")
    sinks.write_fields(rows, ["doc_id", "text"], f"{base}/fields")
    sinks.write_jsonl(rows, f"{base}/jsonl")
    sinks.write_csv(rows.withColumn("text", F.concat(F.lit("<"), "text", F.lit(">"))), f"{base}/csv")
    back = {
        "text": spark.read.text(f"{base}/text").select(F.col("value").alias("text")),
        "fields": readers.read_fields(spark, f"{base}/fields", ["doc_id", "text"]).select("text"),
        "jsonl": spark.read.schema("text string").json(f"{base}/jsonl"),
        "csv": spark.read.schema("doc_id long, text string").option("header", True).csv(f"{base}/csv").select(
            F.regexp_replace("text", "^<|>$", "").alias("text")),
    }
    out = None
    for name, df in back.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")).select(
            F.lit(name).alias("format"), "n", "chars")
        out = part if out is None else out.unionByName(part)
    return out


_HASH = "('0x' || substr(sha256('{p}:' || {k}), 1, 2))::INT"


def hash_sql(prefix: str, key: str, threshold: int) -> str:
    return _HASH.format(p=prefix, k=key) + f" < {threshold}"


@query("a11_split_ledger", f"""
    SELECT 'split_frozen' AS event, count(*) AS n_candidates,
           count(*) FILTER (WHERE {hash_sql('s2', 'doc_id', 38)}) AS n_test, 'third' AS note FROM documents""")
def a11(spark, sf_dir):
    path = shared_dir(spark, "ledger")
    split = splits.hash_split(table(spark, sf_dir, "documents"), "doc_id", "s2", 38)
    for day, note, rows in (("2024-01-01", "first", split.where("lang = 'en'")), ("2024-03-01", "third", split),
                            ("2024-02-01", "second", split.where("lang <> 'en'"))):
        entry = sinks.freeze_entry(rows, "is_test", "sha256(id)[0] < 38", F.lit(day).cast("timestamp"), note)
        sinks.append_ledger(spark, entry, path)
    return sinks.current_freeze(spark.read.parquet(path)).select("event", "n_candidates", "n_test", "note")


@query("a12_run_registry", """
    SELECT lang AS run_id, 'corpus size' AS name, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang""")
def a12(spark, sf_dir):
    """One run per language, null included; the statistics travel as JSON results.

    A folder cannot hold an empty id, so ids carry a prefix.
    """
    path = shared_dir(spark, "runs")
    runs = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))).alias("results"))
    sinks.record_runs(runs.select(
        F.concat(F.lit("lang="), "lang").alias("run_id"), F.lit("corpus size").alias("name"),
        F.lit("2024-01-01").cast("timestamp").alias("started_at"), F.lit("{}").alias("config"), "results"), path)
    parsed = F.from_json("results", "n bigint, chars bigint")
    lang = F.expr("substring(run_id, 6)")
    return sinks.read_runs(spark, path).select(lang.alias("run_id"), "name", parsed.alias("r")).select("run_id", "name", "r.*")


@query("a13_refuse_overwrite", "SELECT count(*) AS n, true AS refused FROM documents")
def a13(spark, sf_dir):
    path = shared_dir(spark, "set")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    sinks.write_table(docs, path)
    try:
        sinks.write_table(docs.limit(0), path)
        refused = False
    except Exception as e:  # Spark names the condition in the message
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


@query("a14_frame_store_check", with_views("""
    SELECT count(*) AS stored, (SELECT count(*) FROM embeddings WHERE label >= 0) AS announced, 0 AS n_faults
    FROM frames""", "frames"))
def a14(spark, sf_dir):
    path = shared_dir(spark, "frames")
    sinks.write_table(frames(spark, sf_dir), path, ["line_id", "frame"])
    stored = spark.read.parquet(path)
    lines = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 10").alias("line_id")).agg(
        F.count("label").alias("n_frames"))
    return frame_store.frame_totals(stored, lines)


@query("a14_width_check", """
    SELECT line_id, n_frames, width, greatest(width // 8, 1) AS expected FROM (
      SELECT vec_id // 10 AS line_id, count(*) AS n_frames, 8 * count(*) + (vec_id // 10) % 13 AS width FROM embeddings GROUP BY vec_id // 10)
    WHERE n_frames <> greatest(width // 8, 1)""")
def a14_width(spark, sf_dir):
    """Lines up to 12 pixels wider than their frames; from 8 on a frame is missing."""
    lines = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 10").alias("line_id")).agg(F.count(F.lit(1)).alias("n_frames"))
    lines = lines.withColumn("width", 8 * F.col("n_frames") + F.col("line_id") % 13)
    return frame_store.width_faults(lines).select("line_id", "n_frames", "width", "expected")


@query("a15_growing_cache", """
    WITH req AS (SELECT conv_id, turn, substr(sha256(text || '{"model": "m", "role": "' || role || '"}'), 1, 24) AS k FROM conversations),
         cache AS (SELECT k, min(round) AS round FROM (SELECT k, 0 AS round FROM req WHERE turn = 0 UNION ALL SELECT k, 1 FROM req WHERE turn = 2) GROUP BY k)
    SELECT r.conv_id, r.turn, coalesce(c.round, -1) AS round FROM req r LEFT JOIN cache c ON c.k = r.k""")
def a15_cache(spark, sf_dir):
    """Two rounds of results are added to a bucketed cache; the second adds only what the first lacks."""
    turns = table(spark, sf_dir, "conversations")
    settings = frame_store.settings_json({"role": F.col("role"), "model": F.lit("m")})
    requests = frame_store.with_cache_key(turns, [F.col("text"), settings]).select("conv_id", "turn", "cache_key")
    schema = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("round", T.IntegerType())])
    cache = frame_store.attach_cache(spark, shared_dir(spark, "cache"), schema, buckets=16)
    for number, turn in enumerate((0, 2)):
        asked = requests.where(F.col("turn") == turn).select("cache_key").distinct()
        missing = frame_store.look_up(asked, cache, buckets=16, how="left_anti")
        frame_store.add_to_cache(missing.withColumn("round", F.lit(number)), cache, buckets=16)
    found = frame_store.look_up(requests, cache, buckets=16, how="left")
    return found.select("conv_id", "turn", F.coalesce("round", F.lit(-1)).alias("round"))


@query("a15_result_cache", """
    WITH req AS (SELECT conv_id, turn, substr(sha256(text || '{"model": "m", "role": "' || role || '"}'), 1, 24) AS k
                 FROM conversations),
         cache AS (SELECT DISTINCT k FROM req WHERE turn = 0)
    SELECT count(*) FILTER (WHERE k IN (FROM cache)) AS hits, count(*) FILTER (WHERE k NOT IN (FROM cache)) AS misses
    FROM req""")
def a15(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    settings = frame_store.settings_json({"role": F.col("role"), "model": F.lit("m")})
    requests = frame_store.with_cache_key(turns, [F.col("text"), settings])
    cache = requests.where("turn = 0").select("cache_key").distinct().withColumn("answer", F.lit("x"))
    hits = frame_store.cache_hits(requests, cache).agg(F.count(F.lit(1)).alias("hits"))
    misses = frame_store.cache_misses(requests, cache).agg(F.count(F.lit(1)))
    return hits.withColumn("misses", misses.scalar())


@query("a16_split_reproduction", f"""
    SELECT count(*) AS n_frozen, 0 AS n_differences FROM documents WHERE {hash_sql('s2', 'doc_id', 38)}""")
def a16(spark, sf_dir):
    path = shared_dir(spark, "frozen")
    test = splits.hash_split(table(spark, sf_dir, "documents"), "doc_id", "s2", 38).where("is_test").select("doc_id")
    sinks.write_lines(test, "doc_id", path)
    frozen = readers.read_ids(spark, path, "doc_id")
    differ = dedupe.symmetric_difference(frozen, test, ["doc_id"]).agg(F.count(F.lit(1)))
    return frozen.agg(F.count(F.lit(1)).alias("n_frozen")).withColumn("n_differences", differ.scalar())


@query("a16_known_checksums", """
    SELECT doc_id // 100 AS bucket, sha256(string_agg(doc_id || ' ' || coalesce(lang, '') || chr(10), '' ORDER BY doc_id)) AS sha256
    FROM documents GROUP BY doc_id // 100""")
def a16_known(spark, sf_dir):
    """One text file per hundred documents, of known lines."""
    path = shared_dir(spark, "summed")
    lines = table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 100").alias("bucket"), "doc_id", F.concat_ws(" ", "doc_id", F.coalesce("lang", F.lit(""))).alias("value"))
    ordered = lines.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    ordered.select("value", "bucket").write.partitionBy("bucket").text(path)
    files = frame_store.file_checksums(spark, path)
    return files.select(F.regexp_extract("path", "bucket=([0-9]+)/", 1).cast("long").alias("bucket"), "sha256")


@query("a16_file_checksums")
def a16_files(spark, sf_dir):
    files = frame_store.file_checksums(spark, f"{sf_dir}/documents.parquet")
    return files.select("length", "sha256")


# ---- B: projections and scalars -------------------------------------------


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


@query("b1_clean_manuscript", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def b1(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.clean_manuscript("text").alias("cleaned"))


@query("b2_single_line", "SELECT doc_id, replace(trim(text, ' ' || chr(10)), chr(10), ' ') AS line FROM documents")
def b2(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.single_line("text").alias("line"))


@query("b3_clean_modern", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM documents")
def b3(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.clean_modern("text").alias("cleaned"))


@query("b4_shortest_reading", f"SELECT doc_id AS id, {_SHORTEST} AS reading FROM documents")
def b4(spark, sf_dir):
    readings = F.create_map(F.lit("interpretation1"), "text", F.lit("interpretation2"), F.concat_ws(" ", "lang", "source"),
                            F.lit("interpretation3"), F.concat_ws(" ", "source", "lang"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), text.shortest_reading(readings).alias("reading"))


@query("b5_normalise", """
    SELECT doc_id, trim(regexp_replace(nfc_normalize(replace(text, 'é', 'e' || chr(769))), '\\s+', ' ', 'g')) AS text
    FROM documents""")
def b5(spark, sf_dir):
    split_accents = F.replace("text", F.lit("é"), F.lit("é"))
    return docs(spark, sf_dir).select("doc_id", nfc.normalise(split_accents).alias("text"))


@query("b6_clean_reply", """
    SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE trim(regexp_replace(regexp_replace(
        translate(text, 'aeiou', 'ಅಎಇಒಉ'), '[^\\x{0C80}-\\x{0CFF}\\x{200C}\\x{200D}\\x{0964}\\x{0965} ]', ' ', 'g'),
        '\\s+', ' ', 'g')) END AS reply FROM documents""")
def b6(spark, sf_dir):
    answer = F.when(F.col("lang") == "es", F.lit("\nUNREADABLE ")).otherwise(F.translate("text", "aeiou", "ಅಎಇಒಉ"))
    raw = F.concat(F.lit("<think>"), "source", F.lit("\n</think>"), answer)
    return docs(spark, sf_dir).select("doc_id", text.clean_reply(raw).alias("reply"))


@query("b7_numbered_reply", """
    SELECT doc_id, lang <> 'fr' OR len(l) = 1 AS accepted,
           CASE WHEN lang <> 'fr' OR len(l) = 1 THEN array_to_string(list_transform(l, lambda x: ltrim(x)), '|') ELSE '' END AS texts
    FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)""")
def b7(spark, sf_dir):
    """Lines numbered 1..n; French replies number every line 1."""
    lines = F.split("text", "\n")
    number = F.transform(lines, lambda s, i: F.concat(
        F.when(F.col("lang") == "fr", F.lit(1)).otherwise(i + 1).cast("string"),
        F.when(i % 2 == 0, F.lit(": ")).otherwise(F.lit(" ) ")), s))
    raw = F.concat(F.lit("<think>1: no\n</think>"), F.array_join(number, "\n"))
    rows = docs(spark, sf_dir).select("doc_id", F.size(lines).alias("n"), raw.alias("raw"))
    parsed = once(rows, ["doc_id"], texts=text.parse_numbered_reply("raw", F.col("n")))
    return parsed.select("doc_id", F.col("texts").isNotNull().alias("accepted"),
                         F.coalesce(F.array_join("texts", "|"), F.lit("")).alias("texts"))


@query("b8_encode", with_views("SELECT doc_id, coalesce(syms, '!') AS symbols FROM symbols", "symbols"))
def b8(spark, sf_dir):
    return coded(spark, sf_dir).select(
        "doc_id", F.coalesce(codec.to_string(codec.unpack("packed")), F.lit("!")).alias("symbols"))


_JOINED = "kn"
for _v, _s in codec.VOWELS.items():
    _m = next((m for m, s in codec.MATRAS.items() if s == _s), "")
    _JOINED = f"replace({_JOINED}, '{codec.VIRAMA}{_v}', '{_m}')"


@query("b9_decode", with_views(f"SELECT doc_id, {_JOINED} AS decoded FROM symbols WHERE syms IS NOT NULL", "symbols"))
def b9(spark, sf_dir):
    return packed(spark, sf_dir).where("packed is not null").select(
        "doc_id", codec.decode_packed("packed").alias("decoded"))


@query("b10_round_trip", with_views("""
    SELECT doc_id, coalesce(syms IS NOT NULL AND digits = 0 AND NOT regexp_matches(kn, '್[ಅ-ಔ]'), false) AS ok, true AS agree
    FROM symbols""", "symbols"))
def b10(spark, sf_dir):
    rule = codec.round_trips("kn")
    return kannada(spark, sf_dir).select(
        "doc_id", rule.alias("ok"),
        (F.coalesce(codec.decode_packed(codec.encode_packed("kn")) == F.col("kn"), F.lit(False)) == rule).alias("agree"))


@query("b11_symbol_strings", with_views("""
    SELECT doc_id, CASE WHEN syms = '' THEN 0 ELSE len(string_split(syms, '|')) END AS n_symbols, true AS same
    FROM symbols WHERE syms IS NOT NULL""", "symbols"))
def b11(spark, sf_dir):
    rows = packed(spark, sf_dir).where("packed is not null").select("doc_id", codec.unpack("packed").alias("s"))
    back = codec.from_string(codec.to_string("s"))
    return rows.select("doc_id", F.size("s").alias("n_symbols"), (back == F.col("s")).alias("same"))


@query("b12_vocabulary", with_views("""
    SELECT s AS symbol, count(*) AS n FROM (SELECT unnest(string_split(syms, '|')) AS s FROM symbols
                                            WHERE syms <> '') GROUP BY s""", "symbols"))
def b12(spark, sf_dir):
    """Symbol frequencies joined to the vocabulary: nothing falls outside it."""
    used = packed(spark, sf_dir).where("packed is not null").select(
        F.explode(codec.indices("packed")).alias("index")).groupBy("index").agg(F.count(F.lit(1)).alias("n"))
    return used.join(codec.vocab_table(spark, digits=True), "index").select("symbol", "n")


_VOCAB = codec.KANNADA.extended_vocab


@query("b13_symbol_indices", with_views(f"""
    SELECT s.doc_id, sum(p * (1 + list_position({_VOCAB}, sym))) AS checksum FROM (
      SELECT doc_id, unnest(l) AS sym, generate_subscripts(l, 1) AS p FROM (
        SELECT doc_id, string_split(syms, '|') AS l FROM symbols WHERE syms <> '')) s GROUP BY s.doc_id""", "symbols"))
def b13(spark, sf_dir):
    """Position-weighted sum of (index + 1) per text; a text without symbols or outside the alphabet has no rows."""
    rows = coded(spark, sf_dir).select("doc_id", F.posexplode(codec.indices("packed")))
    weighted = (F.col("pos") + 1).cast("bigint") * (F.col("col") + 1)
    return rows.groupBy("doc_id").agg(F.sum(weighted).alias("checksum"))


@query("b14_transliterate", with_views("SELECT doc_id, out AS typed FROM typed", "typed"))
def b14(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", translit.to_kannada("text").alias("typed"))


_SENTENCES = """
    SELECT doc_id, trim(s, ' ' || chr(10)) AS sentence FROM (
      SELECT doc_id, unnest(regexp_split_to_array(text, '[।॥.!?\\n]|\\|\\|?')) AS s FROM documents)
    WHERE len(regexp_extract_all(s, '\\S+')) BETWEEN 4 AND 35"""


@query("b15_sentences", _SENTENCES)
def b15(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(text.sentences("text")).alias("sentence")).where(
        text.sentence_ok("sentence"))


_NASALS = "kn"
for _stops, _nasal in spelling.NASAL_BEFORE.items():
    _NASALS = f"regexp_replace({_NASALS}, 'ಂ([{_stops}])', '{_nasal}್\\1', 'g')"


@query("b16_homorganic_nasals", with_views(f"""
    SELECT doc_id, {_NASALS} AS respelled FROM (
      SELECT doc_id, replace(replace(kn, 'ನ್', 'ಂ'), 'ಮ್', 'ಂ') AS kn FROM kannada)""", "kannada"))
def b16(spark, sf_dir):
    """Nasal clusters rewritten with the sign first, so that the rule has work to do."""
    signed = F.replace(F.replace("kn", F.lit("ನ್"), F.lit("ಂ")), F.lit("ಮ್"), F.lit("ಂ"))
    return kannada(spark, sf_dir).select("doc_id", spelling.homorganic_nasals(signed).alias("respelled"))


@query("b17_archaic_swap", with_views("""
    SELECT doc_id, true AS restored, count(*) FILTER (
        WHERE ch = 'ರ' AND regexp_matches(p, '[ಅ-ಔಾಿೀುೂೃೆೇೈೊೋೌ]') AND regexp_matches(n, '[ಅ-ಔಾಿೀುೂೃೆೇೈೊೋೌ]')) AS sites
    FROM (SELECT doc_id, ch, coalesce(lag(ch) OVER w, '') AS p, coalesce(lead(ch) OVER w, '') AS n FROM letters
          WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) GROUP BY doc_id""", "letters"))
def b17(spark, sf_dir):
    """Sites of the first rule, and whether undoing the swaps gives the text back."""
    rows = kannada(spark, sf_dir).where("kn <> ''")
    old, new = spelling.ARCHAIC_SWAPS[0]
    swapped = spelling.archaic_swap("kn", old, new, "doc_id")
    undo = F.replace(swapped, F.lit(new), F.lit(old)) == F.replace("kn", F.lit(new), F.lit(old))
    return rows.select("doc_id", undo.alias("restored"),
                       F.regexp_count("kn", F.lit(spelling.swap_sites(old))).alias("sites"))


@query("b17_certain_swap", """
    WITH sites AS (SELECT doc_id, length(text) - length(replace(text, 'a', '')) AS n FROM documents)
    SELECT doc_id, n AS swapped, 0 AS kept, n AS swapped_back FROM sites""")
def b17_certain(spark, sf_dir):
    """With rate 1 every site between vowels is swapped, with rate 0 none: one site for each letter a of a document."""
    old, new = spelling.ARCHAIC_SWAPS[0]
    site = F.concat(F.lit("ಅ"), F.lit(old), F.lit("ಆ"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.repeat(site, F.regexp_count("text", F.lit("a"))).alias("kn"))
    count = {name: F.regexp_count(spelling.archaic_swap("kn", old, new, "doc_id", rate=rate), F.lit(new)) for name, rate in (("swapped", 1.0), ("kept", 0.0))}
    return rows.select("doc_id", *[c.alias(n) for n, c in count.items()],
                       F.regexp_count(F.replace(spelling.archaic_swap("kn", old, new, "doc_id", rate=1.0), F.lit(new), F.lit(old)), F.lit(old)).alias("swapped_back"))


@query("b18_ratio_band", with_views("""
    SELECT pair_id, round(length(modern_text) / length(old_text), 6) AS ratio FROM pairs
    WHERE length(old_text) > 0 AND length(modern_text) / length(old_text) BETWEEN 0.7 AND 1.5""", "pairs"))
def b18(spark, sf_dir):
    return pairs(spark, sf_dir).where(text.in_band("old_text", "modern_text")).select(
        "pair_id", F.round(text.length_ratio("old_text", "modern_text"), 6).alias("ratio"))


@query("b19_length_cap", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 1 AND 700")
def b19(spark, sf_dir):
    return docs(spark, sf_dir).where(text.usable_length("text")).select("doc_id")


@query("b20_page_stem", with_views("""
    SELECT file_pos, stem, stem[1] AS grp, stem || CASE WHEN is_hd THEN '_hd' ELSE '' END AS page_id FROM photos""",
    "photos"))
def b20(spark, sf_dir):
    return photos(spark, sf_dir).select(
        "file_pos", text.page_stem("path").alias("stem"), text.page_group(text.page_stem("path")).alias("grp"),
        text.page_id("path").alias("page_id"))


@query("b21_quality_bucket", """
    SELECT doc_id, CASE WHEN lang = 'es' OR (n_chars * 7) % 61 < 12 OR (n_chars * 13) % 257 < 15
                          OR (n_chars * 13) % 257 > 240 THEN 'broken'
                        WHEN n_chars % 97 < 40 OR (n_chars * 7) % 61 < 25 THEN 'acceptable' ELSE 'good' END AS bucket
    FROM documents""")
def b21(spark, sf_dir):
    n = F.col("n_chars")
    readable = F.col("lang") != "es"
    return docs(spark, sf_dir).select("doc_id", text.quality_bucket(
        F.when(readable, n % 97), F.when(readable, n * 7 % 61), F.when(readable, n * 13 % 257)).alias("bucket"))


@query("b22_line_strip", "SELECT doc_id, n_chars / greatest(length(source) * 50, 1) >= 6.0 AS strip FROM documents")
def b22(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", text.is_line_strip("n_chars", F.char_length("source") * 50).alias("strip"))


@query("b23_scaled_width", """
    SELECT doc_id, greatest(8, round_even(n_chars * 64.0::DOUBLE / (37 + doc_id % 91), 0))::BIGINT AS width,
           greatest(1, n_chars // 8) AS frames FROM documents""")
def b23(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", text.scaled_width("n_chars", 37 + F.col("doc_id") % 91).alias("width"),
        text.frame_count("n_chars", at_least_one=True).alias("frames"))


@query("b24_character_counts", """
    SELECT doc_id, len(string_split(text, 'e')) - 1 AS n_e, len(string_split(text, 'th')) - 1 AS n_th,
           contains(text, 'é') AS has_accent, replace(text, 'e', 'a') AS replaced FROM documents""")
def b24(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", text.count_of("text", "e").alias("n_e"), text.count_of("text", "th").alias("n_th"),
        F.contains("text", F.lit("é")).alias("has_accent"), text.replace_char("text", "e", "a").alias("replaced"))


@query("b25_character_vocabulary", """
    SELECT c AS char, row_number() OVER (ORDER BY c) + 3 AS id FROM (
      SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents)
    UNION ALL VALUES ('<pad>', 0), ('<bos>', 1), ('<eos>', 2), ('<unk>', 3)""")
def b25(spark, sf_dir):
    return charvocab.build_char_vocab(docs(spark, sf_dir), "text")


@query("b26_encode_characters", """
    WITH vocab AS (SELECT c, row_number() OVER (ORDER BY c) + 3 AS id FROM (
        SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark)),
      chars AS (SELECT conv_id, turn, unnest(l) AS c, generate_subscripts(l, 1) AS p FROM (
        SELECT conv_id, turn, string_split(text, '') AS l FROM conversations))
    SELECT conv_id, turn, sum(p * coalesce(id, 3)) AS checksum,
           string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE chars.c END, '' ORDER BY p) AS decoded
    FROM chars LEFT JOIN vocab ON vocab.c = chars.c GROUP BY conv_id, turn""")
def b26(spark, sf_dir):
    """Turns encoded with the benchmark's characters; unknown ones are marked."""
    vocab = charvocab.build_char_vocab(table(spark, sf_dir, "benchmark"), "text")
    turns = table(spark, sf_dir, "conversations").where("text <> ''")
    ids = charvocab.encode_chars(turns, ["conv_id", "turn"], "text", vocab)
    names = vocab.agg(F.sort_array(F.collect_list(F.struct("id", "char")))["char"])
    weighted = F.aggregate(
        F.transform("ids", lambda x, i: (i + 1).cast("bigint") * x), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ids.withColumn("names", names.scalar()).select(
        "conv_id", "turn", weighted.alias("checksum"), charvocab.decode_ids("ids", F.col("names")).alias("decoded"))


@query("b27_review_tokens", """
    SELECT conv_id * 1000000 + turn AS sentence_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS token, role AS tag
    FROM (SELECT *, regexp_extract_all(text, '\\S+') AS l FROM conversations)""")
def b27(spark, sf_dir):
    return tokens(spark, sf_dir)


def tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("sentence_id"),
        F.posexplode(words("text")).alias("pos", "token"), F.col("role").alias("tag"))


_PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ,.\n"


@query("b28_coverage", f"""
    SELECT doc_id, CASE WHEN m = '' THEN 'primary' WHEN translate(m, 'éèêàç', '') = '' THEN 'fallback' ELSE 'skipped' END AS chosen,
           CASE WHEN translate(m, 'éèêàç', '') = '' THEN '' ELSE translate(m, 'éèêàç', '') END AS missing
    FROM (SELECT doc_id, coalesce((SELECT string_agg(c, '' ORDER BY c) FROM (
            SELECT DISTINCT unnest(string_split(text, '')) AS c) WHERE NOT contains('{_PLAIN}', c)), '') AS m FROM documents)""")
def b28(spark, sf_dir):
    primary = F.split(F.lit(_PLAIN), "")
    fallback = F.split(F.lit(_PLAIN + "éèêàç"), "")
    rows = docs(spark, sf_dir).select("doc_id", text.missing_chars("text", primary).alias("m"))
    still = F.array_except("m", fallback)
    chosen = F.when(F.size("m") == 0, "primary").when(F.size(still) == 0, "fallback").otherwise("skipped")
    return rows.select("doc_id", chosen.alias("chosen"), F.array_join(still, "").alias("missing"))


# ---- the corpus builds ------------------------------------------------------


def typed_verses(spark, sf_dir):
    """Documents typed into script as verses, with their plain text as interpretation."""
    return docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), translit.to_kannada("text").alias("verse"),
        F.create_map(F.lit("interpretation1"), F.col("text")).alias("interpretations"))


_LINES = f"""
    SELECT k.doc_id AS id, k.kn AS text FROM symbols k
    WHERE k.syms IS NOT NULL AND k.digits = 0 AND length(k.kn) BETWEEN 1 AND 700
      AND NOT regexp_matches(k.kn, '್[ಅ-ಔ]')"""


@query("corpus_old_lines", with_views(_LINES, "symbols"))
def corpus_lines(spark, sf_dir):
    return corpus.old_lines(typed_verses(spark, sf_dir))


@query("corpus_verse_pairs", with_views(f"""
    SELECT l.id AS verse_id, l.text AS old_text, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS modern_text
    FROM ({_LINES}) l JOIN documents d ON d.doc_id = l.id""", "symbols"))
def corpus_pairs(spark, sf_dir):
    return corpus.verse_pairs(typed_verses(spark, sf_dir))


@query("corpus_rule_pairs")
def corpus_rule_pairs(spark, sf_dir):
    """Sentences of the typed documents respelled by rule; the coin is Spark's hash."""
    typed = docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.create_map(F.lit("interpretation1"), translit.to_kannada("text")).alias(
            "interpretations"))
    return corpus.rule_pairs(typed)


@query("corpus_funnel", with_views("""
    SELECT CASE WHEN kn = '' THEN 'empty' WHEN length(kn) > 700 THEN 'too_long'
                WHEN syms IS NULL OR digits > 0 THEN 'unencodable'
                WHEN regexp_matches(kn, '್[ಅ-ಔ]') THEN 'ambiguous' ELSE 'kept' END AS fate, count(*) AS n
    FROM symbols GROUP BY fate""", "symbols"))
def corpus_funnel(spark, sf_dir):
    return corpus.corpus_funnel(typed_verses(spark, sf_dir))


@query("corpus_in_band_ids", with_views("""
    SELECT pair_id AS verse_id FROM pairs WHERE length(old_text) > 0
       AND length(modern_text) / length(old_text) BETWEEN 0.7 AND 1.5""", "pairs"))
def in_band_ids(spark, sf_dir):
    return pairs(spark, sf_dir).where(text.in_band("old_text", "modern_text")).select(
        F.col("pair_id").alias("verse_id"))

