"""Join, split, dedupe and batching queries (sections C, D, E, K and L)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.hashing import fraction_threshold, in_hash_split
from ..functions.metrics import agreement_cer
from ..operators import dedupe, joins, labels, packing, reports, splits
from ..session import shared_dir, stored
from ..streaming.inbox import ingest_inbox
from .adapters import agreement, crops, label_rows, photos, readings, spread, table, with_views
from .registry import query
from .text_queries import hash_sql


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def draw_sql(seed: object, *keys: str) -> str:
    return f"sha256('{seed}:' || " + " || ':' || ".join(keys) + ")"


# ---- C: joins -----------------------------------------------------------------


@query("c1_membership_flag", """
    SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_good FROM documents""")
def c1(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return joins.flag_members(docs(spark, sf_dir).select("doc_id"), "doc_id", good, "is_good")


@query("c1_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def c1_semi(spark, sf_dir):
    return joins.only_members(docs(spark, sf_dir), ["doc_id"], table(spark, sf_dir, "labels")).select("doc_id", "lang")


@query("c2_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c2(spark, sf_dir):
    return joins.without_members(docs(spark, sf_dir), ["doc_id"], table(spark, sf_dir, "labels")).select("doc_id")


_SIG = "width, height, sharpness, contrast, brightness"


@query("c2_page_exclusion", with_views(f"""
    SELECT file_pos FROM photos p WHERE stem NOT IN (SELECT stem FROM photos WHERE lang = 'es')
      AND NOT EXISTS (SELECT 1 FROM photos q WHERE q.lang = 'de' AND (q.width, q.height, q.sharpness, q.contrast, q.brightness)
                      = (p.width, p.height, p.sharpness, p.contrast, p.brightness) AND p.width IS NOT NULL)""", "photos"))
def c2_pages(spark, sf_dir):
    """Spanish pages go by stem, German photos by signature."""
    rows = photos(spark, sf_dir).withColumn("stem", text.page_stem("path"))
    kept = joins.exclude_pages(rows, rows.where("lang = 'es'"), rows.where("lang = 'de'"), dedupe.SIGNATURE)
    return kept.select("file_pos")


@query("c3_common_rows", """
    SELECT d.doc_id, d.lang, l.quality, b.item_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    JOIN benchmark b ON b.item_id = d.doc_id""")
def c3(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "item_id")
    return joins.common_rows("doc_id", docs(spark, sf_dir), table(spark, sf_dir, "labels"), bench).select(
        "doc_id", "lang", "quality", "item_id")


@query("c4_positional_join", "SELECT doc_id AS row_id, lang, length(text) AS chars FROM documents")
def c4(spark, sf_dir):
    a = docs(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "lang")
    b = docs(spark, sf_dir).select(F.col("doc_id").alias("row_id"), F.char_length("text").alias("chars"))
    return joins.positional_join(a, b)


@query("c5_lookup_funnel", """
    SELECT count(*) AS candidates, count(l.doc_id) AS found FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def c5(spark, sf_dir):
    candidates = docs(spark, sf_dir)
    found = candidates.join(table(spark, sf_dir, "labels"), "doc_id").agg(F.count(F.lit(1)))
    return candidates.agg(F.count(F.lit(1)).alias("candidates")).withColumn("found", found.scalar())


_CLOSEST = f"""
    SELECT a.crop, round(min({agreement('a.text', 'o.text')}), 6) AS disagreement
    FROM label_rows a JOIN label_rows o ON o.crop = a.crop AND o.labeller <> 'alpha' AND trim(o.text) <> ''
    WHERE a.labeller = 'alpha' GROUP BY a.crop"""


@query("c6_closest_labeller", with_views(_CLOSEST, "label_rows"))
def c6(spark, sf_dir):
    rows = label_rows(spark, sf_dir)
    closest = labels.closest_other(rows.where("labeller = 'alpha'"), rows.where("labeller <> 'alpha'"))
    return closest.select("crop", F.round("disagreement", 6).alias("disagreement"))


@query("c7_reading_pairs", with_views(f"""
    SELECT a.crop, a.sample_idx AS i, b.sample_idx AS j, round({agreement('a.text', 'b.text')}, 6) AS d
    FROM readings a JOIN readings b ON a.crop = b.crop AND a.sample_idx < b.sample_idx""", "readings"))
def c7(spark, sf_dir):
    found = joins.self_pairs(readings(spark, sf_dir), "crop", "sample_idx", "text")
    return found.select("crop", "i", "j", F.round(agreement_cer("a", "b"), 6).alias("d"))


@query("c8_column_override", with_views("""
    SELECT a.crop, b.text FROM label_rows a JOIN label_rows b ON a.crop = b.crop
    WHERE a.labeller = 'alpha' AND b.labeller = 'beta'""", "label_rows"))
def c8(spark, sf_dir):
    rows = label_rows(spark, sf_dir)
    out = joins.override_column(rows.where("labeller = 'alpha'"), rows.where("labeller = 'beta'"), "crop", "text")
    return out.select("crop", "text")


@query("c9_completeness", "SELECT 0 AS n_missing FROM (SELECT count(*) FROM labels)")
def c9(spark, sf_dir):
    return joins.require_all(table(spark, sf_dir, "labels"), docs(spark, sf_dir), "doc_id")


@query("c10_disjoint_sets", """
    SELECT lang AS "set", count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, 0 AS n_shared FROM documents GROUP BY lang""")
def c10(spark, sf_dir):
    return joins.require_disjoint_values(docs(spark, sf_dir), "lang", "doc_id")


# ---- D: splits and samples ------------------------------------------------------


@query("d1_frozen_hash_split", f"SELECT doc_id, {hash_sql('s2', 'doc_id', 38)} AS is_test FROM documents")
def d1(spark, sf_dir):
    return splits.hash_split(docs(spark, sf_dir).select("doc_id"), "doc_id", "s2", 38)


@query("d2_prefixed_splits", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{p}' AS prefix, count(*) FILTER (WHERE {hash_sql(p, 'doc_id', t)}) AS n FROM documents"
    for p, t in (("s1", 12), ("s2ft", 25), ("s3", 5), ("real", 51))) + ")")
def d2(spark, sf_dir):
    wanted = (("s1", 0.05), ("s2ft", 0.1), ("s3", 0.02), ("real", 0.2))
    counts = docs(spark, sf_dir).agg(*[
        F.count_if(in_hash_split("doc_id", p, fraction_threshold(f))).alias(p) for p, f in wanted])
    rows = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(p).alias("n")) for p, _ in wanted])
    return counts.select(F.inline(rows))


@query("d3_frozen_list", f"""
    SELECT d.doc_id, coalesce(l.quality = 1, {hash_sql('s2', 'd.doc_id', 38)}) AS is_test
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def d3(spark, sf_dir):
    frozen = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_test"))
    return splits.frozen_split(docs(spark, sf_dir).select("doc_id"), frozen, "doc_id", "s2", 38)


@query("d4_fill_to_size", f"""
    WITH s AS (SELECT doc_id, {hash_sql('s2', 'doc_id', 38)} AS is_test FROM documents)
    SELECT doc_id, is_test FROM s WHERE is_test UNION ALL
    SELECT doc_id, false FROM (SELECT doc_id, row_number() OVER (ORDER BY {draw_sql(0, 'doc_id')}) AS r FROM s WHERE NOT is_test)
    WHERE r <= 400 - (SELECT count(*) FROM s WHERE is_test)""")
def d4(spark, sf_dir):
    split = splits.hash_split(docs(spark, sf_dir).select("doc_id"), "doc_id", "s2", 38)
    return splits.fill_to(split, "is_test", "doc_id", 400).select("doc_id", "is_test")


@query("d5_sample_pages", f"""
    SELECT page FROM (SELECT DISTINCT lang || '.' || source AS page FROM documents)
    ORDER BY {draw_sql(0, 'page')} LIMIT 20""")
def d5(spark, sf_dir):
    return splits.sample_pages(docs(spark, sf_dir).select(F.concat_ws(".", "lang", "source").alias("page")), "page", 20)


@query("d6_stratified_sample", f"""
    SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY lang, r) AS k FROM (
      SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {draw_sql(0, 'doc_id')}) AS r FROM documents)
      WHERE r <= ceil(90 / 4)) WHERE k <= 90""")
def d6(spark, sf_dir):
    return splits.stratified(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", 90)


@query("d7_whole_pages", """
    SELECT doc_id FROM (
      SELECT doc_id, row_number() OVER (ORDER BY lang, source, doc_id) AS k FROM documents) WHERE k <= 150""")
def d7(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", "source")
    return splits.whole_pages(rows, "source", "doc_id", 150, F.col("lang")).select("doc_id")


@query("d8_pages_to_budget", f"""
    SELECT lang, source, n FROM (
      SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY {draw_sql(0, 'source')}
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)) WHERE b < 50""")
def d8(spark, sf_dir):
    pages = docs(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return splits.pages_to_budget(pages, "lang", "source", "n", 50)


@query("d8_training_pages", with_views(f"""
    SELECT stem, n_lines FROM (
      SELECT *, coalesce(sum(n_lines) OVER (PARTITION BY stem[1] ORDER BY {draw_sql(1, 'stem')}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY is_hd, file_pos) AS r FROM photos
          WHERE n_lines >= 1 AND stem NOT IN (SELECT stem FROM photos WHERE lang = 'es')) WHERE r = 1)) WHERE b < 60""",
    "photos"))
def d8_training(spark, sf_dir):
    """Eligible pages by survey, then pages per group up to a line budget."""
    rows = photos(spark, sf_dir)
    survey = rows.select("path", "file_pos", F.create_map(F.lit("line"), "n_lines").alias("class_counts"),
                         F.when(F.col("n_lines").isNull(), F.lit("unreadable")).alias("error"))
    stems = rows.where("lang = 'es'").select(text.page_stem("path").alias("stem"))
    none = rows.where("false")
    pages = dedupe.eligible_pages(rows.select("path", *dedupe.SIGNATURE).distinct(), survey, stems, none, "line")
    return splits.pages_to_budget(pages, "group", "stem", "n_lines", 60, seed=1).select("stem", "n_lines")


@query("d9_holdout_every_fourth", """
    SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 4 = 3
                        THEN 'holdout' ELSE 'train' END AS demo_split FROM documents""")
def d9(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    return splits.holdout_every(rows, "lang", ["doc_id"], 4, F.floor(F.col("doc_id") / 65536)).select("doc_id", "demo_split")


@query("d10_split_override", f"""
    SELECT 'given' AS variant, d.doc_id, coalesce(l.toxic = 1, false) AS is_validation
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    UNION ALL SELECT 'hashed', doc_id, {hash_sql('real', 'doc_id', 51)} FROM documents""")
def d10(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, F.lit("holdout")).otherwise("train").alias("demo_split"))
    given = docs(spark, sf_dir).select("doc_id").join(marks, "doc_id", "left")
    bare = given.withColumn("demo_split", F.lit(None).cast("string"))
    out = None
    for name, df in (("given", given), ("hashed", bare)):
        part = splits.split_with_override(df, "demo_split", "doc_id", "real", 51).select(
            F.lit(name).alias("variant"), "doc_id", "is_validation")
        out = part if out is None else out.unionByName(part)
    return out


@query("d11_learning_curve", f"""
    SELECT s AS subset, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {draw_sql(0, 'doc_id')}) AS r FROM documents),
      (VALUES (13), (52), (105)) v(s) WHERE r <= s""")
def d11(spark, sf_dir):
    return splits.learning_curve(docs(spark, sf_dir).select("doc_id"), "doc_id", [13, 52, 105]).select("subset", "doc_id")


@query("d12_permutation_split", f"""
    SELECT doc_id, row_number() OVER (ORDER BY {draw_sql(0, 'doc_id')}) <= (SELECT floor(count(*) * 0.2) FROM documents) AS is_test
    FROM documents""")
def d12(spark, sf_dir):
    return splits.hash_permutation_split(docs(spark, sf_dir).select("doc_id"), "doc_id", 0.2)


@query("d13_replay_mix", f"""
    WITH own AS (SELECT doc_id FROM documents WHERE lang = 'de'),
      other AS (SELECT doc_id, {hash_sql('s1', 'doc_id', 25)} AS v FROM documents WHERE lang = 'en')
    SELECT doc_id, 'own' AS origin FROM own UNION ALL
    SELECT doc_id, 'replay' FROM (SELECT doc_id, row_number() OVER (ORDER BY {draw_sql(0, 'doc_id')}) AS r FROM other WHERE NOT v)
    WHERE r <= (SELECT floor(count(*) * 1.5) FROM own) UNION ALL
    SELECT doc_id, 'replay_validation' FROM (
      SELECT doc_id, row_number() OVER (ORDER BY {draw_sql('validation', 'doc_id')}) AS r FROM other WHERE v) WHERE r <= 20""")
def d13(spark, sf_dir):
    rows = docs(spark, sf_dir)
    own = rows.where("lang = 'de'").select("doc_id")
    other = splits.hash_split(rows.where("lang = 'en'").select("doc_id"), "doc_id", "s1", 25, "v")
    return splits.replay_mix(own, other, "doc_id", 1.5, 20, "v").select("doc_id", "origin")


# ---- E: dedupe and sets ------------------------------------------------------------


@query("e1_distinct_sentences", """
    SELECT DISTINCT trim(s, ' ' || chr(10)) AS sentence FROM (
      SELECT unnest(regexp_split_to_array(text, '[।॥.!?\\n]|\\|\\|?')) AS s FROM documents)
    WHERE len(regexp_extract_all(s, '\\S+')) BETWEEN 4 AND 35""")
def e1(spark, sf_dir):
    return dedupe.distinct_sentences(spread(docs(spark, sf_dir), "doc_id"), "text")


@query("e2_first_per_signature", with_views(f"""
    SELECT min(file_pos) AS file_pos FROM photos WHERE width IS NOT NULL GROUP BY {_SIG}""", "photos"))
def e2(spark, sf_dir):
    return dedupe.first_per_signature(photos(spark, sf_dir)).select("file_pos")


@query("e3_one_per_page", with_views("""
    SELECT stem, file_pos FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY is_hd, file_pos) AS r FROM photos)
    WHERE r = 1""", "photos"))
def e3(spark, sf_dir):
    return dedupe.one_per_page(photos(spark, sf_dir)).select("stem", "file_pos")


def _label_files(spark, sf_dir):
    """Label rows as concatenated files: position is (labeller, crop)."""
    return label_rows(spark, sf_dir).withColumn("file_pos", F.struct("labeller", "crop")).withColumn(
        "image", F.when(F.col("labeller") != "gamma", F.concat(F.lit("img/"), "crop")))


@query("e4_first_per_image", with_views("""
    SELECT k AS image, min(labeller) AS labeller FROM (
      SELECT CASE WHEN labeller <> 'gamma' THEN 'img/' || crop ELSE crop END AS k, labeller FROM label_rows) GROUP BY k""",
    "label_rows"))
def e4(spark, sf_dir):
    first = dedupe.first_per_image(_label_files(spark, sf_dir))
    return first.select(F.coalesce("image", "crop").alias("image"), "labeller")


@query("e5_last_per_crop", with_views(
    "SELECT crop, max(labeller) AS labeller FROM label_rows GROUP BY crop", "label_rows"))
def e5(spark, sf_dir):
    return dedupe.last_per_crop(_label_files(spark, sf_dir)).select("crop", "labeller")


@query("e6_tagged_union", """
    SELECT 'benchmark' AS source_tag, count(*) AS n, sum(length(text)) AS chars, 0 AS with_lang FROM benchmark
    UNION ALL SELECT 'documents', count(*), sum(length(text)), count(lang) FROM documents""")
def e6(spark, sf_dir):
    both = dedupe.tagged_union(documents=docs(spark, sf_dir), benchmark=table(spark, sf_dir, "benchmark"))
    return both.groupBy("source_tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.count("lang").alias("with_lang"))


@query("e7_id_set_counts", """
    SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS only_a, count(*) FILTER (WHERE d.doc_id IS NULL) AS only_b,
           count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS "both"
    FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def e7(spark, sf_dir):
    return dedupe.id_set_counts(docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


# ---- K: sorts and top-k --------------------------------------------------------------


@query("k1_first_rows", with_views("SELECT page, crop FROM crops ORDER BY page, crop LIMIT 10", "crops"))
def k1(spark, sf_dir):
    return crops(spark, sf_dir).select("page", "crop").orderBy("page", "crop").limit(10)


@query("k3_ordered_by_id", "SELECT doc_id, lang FROM documents ORDER BY doc_id")
def k3(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang").orderBy("doc_id")


@query("k4_largest_pages", with_views("""
    SELECT page, count(*) AS n_lines FROM crops GROUP BY page ORDER BY n_lines DESC, page LIMIT 12""", "crops"))
def k4(spark, sf_dir):
    counts = crops(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("n_lines"))
    return reports.largest(counts, "n_lines", "page", 12)


@query("j4_reading_order", with_views("""
    SELECT crop, row_number() OVER (PARTITION BY page ORDER BY width, crop) - 1 AS line_index FROM crops""", "crops"))
def j4(spark, sf_dir):
    rows = crops(spark, sf_dir).select("page", "crop", F.col("width").cast("double").alias("centroid_y"))
    return reports.reading_order(rows, "page", "centroid_y", "crop").select("crop", "line_index")


# ---- L: incremental work and batches -----------------------------------------------------


@query("l1_pending_crops", with_views("""
    SELECT crop FROM crops WHERE crop NOT IN (SELECT crop FROM label_rows WHERE labeller = 'beta')""",
    "crops", "label_rows"))
def l1(spark, sf_dir):
    """Crops the second labeller still owes; its failed rows carry no text."""
    done = label_rows(spark, sf_dir).where("labeller = 'beta'")
    failed = crops(spark, sf_dir).select("crop", F.lit("beta").alias("labeller"), F.lit(None).cast("string").alias("text"))
    return labels.pending_crops(crops(spark, sf_dir), done.unionByName(failed)).select("crop")


@query("l2_inbox_ingest", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_keys FROM events GROUP BY event_type")
def l2(spark, sf_dir):
    """Events land as JSON files, twice; the stream takes every key once."""
    base = shared_dir(spark, "inbox")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    events.repartition(6, "event_id").write.json(f"{base}/in")
    events.repartition(2, "event_id").write.mode("append").json(f"{base}/in")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    run = ingest_inbox(spark, f"{base}/in", schema, ["event_id"], f"{base}/out", f"{base}/checkpoint", 4)
    run.awaitTermination()
    landed = spark.read.parquet(f"{base}/out")
    return landed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_keys"))


@query("l3_page_batches", with_views("""
    SELECT page, crop, (row_number() OVER (PARTITION BY page ORDER BY position) - 1) // 5 AS batch FROM crops""", "crops"))
def l3(spark, sf_dir):
    return packing.page_batches(crops(spark, sf_dir), "page", "position", 5).select("page", "crop", "batch")


def _greedy_sql(rows: str, budget: int, body: str, *views: str) -> str:
    """The batches of one pass over all rows in order: a row at a time."""
    return (with_views("", *views).rstrip() + ", " if views else "WITH ").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
    ordered AS (SELECT row_number() OVER (ORDER BY h * w, id) AS i, * FROM ({rows})),
    walk AS (
      SELECT i, id, h, w, 1 AS n, h AS th, w AS tw, 0 AS batch FROM ordered WHERE i = 1
      UNION ALL
      SELECT i, id, h, w, CASE WHEN closed THEN 1 ELSE n + 1 END, CASE WHEN closed THEN h ELSE greatest(th, h) END,
             CASE WHEN closed THEN w ELSE greatest(tw, w) END, batch + closed::INT FROM (
        SELECT o.i, o.id, o.h, o.w, p.n, p.th, p.tw, p.batch,
               p.n >= 64 OR (p.n + 1) * greatest(p.th, o.h) * greatest(p.tw, o.w) > {budget} AS closed
        FROM walk p JOIN ordered o ON o.i = p.i + 1))
    {body}"""


_CROP_SIZES = "SELECT crop AS id, greatest(height, 1)::BIGINT AS h, width::BIGINT AS w FROM crops"
_DOC_SIZES = "SELECT doc_id AS id, 1::BIGINT AS h, n_chars AS w FROM documents"


def _area_batches(spark, sf_dir):
    return packing.budget_batches(crops(spark, sf_dir), "crop", F.greatest("height", F.lit(1)), F.col("width"), 1_000_000, 64)


def _length_batches(spark, sf_dir):
    return packing.length_batches(docs(spark, sf_dir), "doc_id", F.col("n_chars"), 50_000, 64)


@query("l4_area_batches", with_views("""
    SELECT true AS within_budget, count(*) AS n_rows FROM crops""", "crops"))
def l4(spark, sf_dir):
    """Every row batched once, and every batch of two or more within budget."""
    return _batch_report(_area_batches(spark, sf_dir).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), (F.max("h") * F.max("w")).alias("cost")), 1_000_000)


@query("l4_batch_numbers", _greedy_sql(_CROP_SIZES, 1_000_000, "SELECT id AS crop, batch FROM walk", "crops"))
def l4_numbers(spark, sf_dir):
    return _area_batches(spark, sf_dir).select("crop", "batch")


@query("l5_length_batches", "SELECT true AS within_budget, count(*) AS n_rows FROM documents")
def l5(spark, sf_dir):
    return _batch_report(_length_batches(spark, sf_dir).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.max("length").alias("cost")), 50_000)


@query("l5_batch_numbers", _greedy_sql(_DOC_SIZES, 50_000, "SELECT id AS doc_id, batch FROM walk"))
def l5_numbers(spark, sf_dir):
    return _length_batches(spark, sf_dir).select("doc_id", "batch")


def _batch_report(batches, budget):
    fits = (F.col("n") == 1) | ((F.col("n") * F.col("cost") <= budget) & (F.col("n") <= 64))
    return batches.agg(F.bool_and(fits).alias("within_budget"), F.sum("n").alias("n_rows"))


# ---- label sets (F1, F2, F23) ---------------------------------------------------------------

_SCREEN = """
    screened AS (
      SELECT c.crop, c.page, trim(a.text, ' ' || chr(10)) AS text, c.width, c.height,
             CASE WHEN c.height > 0 THEN c.width / c.height ELSE 0 END AS aspect,
             CASE WHEN length(trim(a.text, ' ' || chr(10))) = 0 THEN 'empty'
                  WHEN length(trim(a.text, ' ' || chr(10))) < 8 THEN 'short'
                  WHEN regexp_matches(a.text, '[^\\x00-\\x7F]') THEN 'unencodable' END AS r1
      FROM label_rows a JOIN crops c ON c.crop = a.crop WHERE a.labeller = 'alpha'),
    dens AS (SELECT length(text) / aspect AS d FROM screened WHERE r1 IS NULL AND aspect <> 0),
    med AS (SELECT median(d) AS m, count(*) AS n FROM dens),
    band AS (SELECT n, m, CASE WHEN mad = 0 THEN 1e-6 ELSE mad END AS mad FROM (
      SELECT any_value(n) AS n, any_value(m) AS m, median(abs(d - m)) AS mad FROM dens, med)),
    closest AS (SELECT * FROM (""" + _CLOSEST.replace("a.text", "trim(a.text, ' ' || chr(10))") + """)),
    label_set AS (
      SELECT s.*, CASE WHEN r1 IS NULL AND r2 IS NULL THEN disagreement END AS disagreement,
             coalesce(r1, r2, CASE WHEN disagreement > 0.35 THEN 'disagreement' END) AS reason FROM (
        SELECT screened.*, CASE WHEN n >= 8 AND NOT (CASE WHEN aspect <> 0 THEN length(text) / aspect ELSE 0 END)
                           BETWEEN m - 3.5 * mad AND m + 3.5 * mad THEN 'length' END AS r2 FROM screened, band) s
      LEFT JOIN closest USING (crop))"""


def _label_sql(body: str) -> str:
    return with_views("", "label_rows", "crops").rstrip() + "," + _SCREEN + body


def _label_set(spark, sf_dir, exact=True):
    plain = ~F.col("text").rlike(r"[^\x00-\x7F]")
    return labels.build_label_set(label_rows(spark, sf_dir), crops(spark, sf_dir), is_encodable=plain, exact=exact)


@query("f1_rejection_funnel", _label_sql("""
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM label_set GROUP BY 1"""))
def f1(spark, sf_dir):
    return labels.funnel(_label_set(spark, sf_dir, exact=False))


@query("f2_length_band", _label_sql("""
    SELECT n, round(m, 6) AS median, round(mad, 6) AS mad, round(m - 3.5 * mad, 6) AS low, round(m + 3.5 * mad, 6) AS high
    FROM band"""))
def f2(spark, sf_dir):
    plain = ~F.col("text").rlike(r"[^\x00-\x7F]")
    screened = labels.screen_candidates(label_rows(spark, sf_dir), crops(spark, sf_dir), is_encodable=plain)
    band = labels.length_band(screened)
    return band.select("n", *[F.round(c, 6).alias(c) for c in ("median", "mad", "low", "high")])


@query("f23_cross_check", _label_sql("""
    SELECT count(disagreement) AS n_cross_checked, round(avg(disagreement), 5) AS mean_disagreement,
           count(*) FILTER (WHERE reason IS NULL) AS n_kept,
           coalesce(sum(length(text)) FILTER (WHERE reason IS NULL), 0) AS total_chars,
           count(DISTINCT page) FILTER (WHERE reason IS NULL) AS n_pages FROM label_set"""))
def f23(spark, sf_dir):
    report = labels.cross_check_report(_label_set(spark, sf_dir))
    return report.withColumn("mean_disagreement", F.round("mean_disagreement", 5))


@query("f23_kept_pages", _label_sql("SELECT DISTINCT page FROM label_set WHERE reason IS NULL"))
def f23_pages(spark, sf_dir):
    return labels.kept_pages(_label_set(spark, sf_dir))


@query("labels_holdout", _label_sql("""
    SELECT crop, CASE WHEN (row_number() OVER (PARTITION BY page ORDER BY crop) - 1) % 4 = 3 THEN 'holdout' ELSE 'train' END
           AS demo_split FROM label_set WHERE reason IS NULL"""))
def labels_holdout(spark, sf_dir):
    """The whole label-set build with every fourth line of a page held out."""
    kept = stored(_label_set(spark, sf_dir).where("reason is null").select("crop", "page"), "label-set")
    placed = kept.join(crops(spark, sf_dir).select("crop", "position"), "crop")
    out = splits.holdout_every(placed, "page", ["crop"], 4, F.floor(F.col("position") / 65536))
    return out.select("crop", "demo_split")
