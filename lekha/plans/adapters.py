"""Stand-ins for the operators' tables, derived from the driver tables.

Each Spark view has a SQL twin in ``VIEWS`` for the check. All of them read
whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import encode_packed
from ..functions.expr import once
from ..functions.translit import to_clean_kannada
from . import script_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, old_text, modern_text): a user turn and the reply that follows.

    The neighbour is found by joining turn numbers, so a very long
    conversation is no hot group.
    """
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id")
    user = turns.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("old_text"), (F.col("turn") + 1).alias("next"))
    reply = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("modern_text"))
    return user.join(reply, ["conv_id", "next"]).select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("pair_id"), "old_text", "modern_text")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(crop, sample_idx, text): six readings of each benchmark passage."""
    t = F.col("text")
    edits = [t, t, F.replace(t, F.lit("th"), F.lit("d")), F.concat(F.lit("x "), t),
             F.replace(t, F.lit("on"), F.lit("o")), F.lit("  ")]
    return spread(table(spark, sf_dir, "benchmark"), "item_id").select(
        F.col("item_id").alias("crop"), F.posexplode(F.array(*edits)).alias("sample_idx", "text"))


def known_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(crop, sample_idx, text): readings whose errors stand where a mark is that no passage has.

    Such a mark can only replace the letter in its place, so every alignment is known.
    """
    t = F.translate("text", "#@", "  ")
    one, two = F.replace(t, F.lit("e"), F.lit("#")), F.replace(t, F.lit("a"), F.lit("@"))
    both = F.replace(one, F.lit("a"), F.lit("@"))
    return spread(table(spark, sf_dir, "benchmark"), "item_id").select(
        F.col("item_id").alias("crop"), F.posexplode(F.array(t, t, one, two, both, t)).alias("sample_idx", "text"))


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(crop, labeller, text): three labellers over the conversation turns."""
    t = F.col("text")
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id")
    named = turns.select("role", crop_id(), F.explode(F.array(
        F.struct(F.lit("alpha").alias("labeller"), F.when(F.col("role") == "system", F.concat(F.lit(" "), F.regexp_replace(
            t, "[A-Za-z]", ""))).otherwise(t).alias("text")),
        F.struct(F.lit("beta").alias("labeller"), F.when(F.col("role") != "system", F.replace(F.replace(
            t, F.lit("eau"), F.lit("o")), F.lit("en"), F.lit(""))).alias("text")),
        F.struct(F.lit("gamma").alias("labeller"), F.when(F.col("role") == "assistant", F.replace(
            t, F.lit("e"), F.lit(""))).alias("text")),
    )).alias("x"))
    return named.where("x.text is not null").select("crop", "x.labeller", "x.text")


def crop_id():
    return F.concat_ws("_", F.lpad(F.col("conv_id").cast("string"), 19, "0"), F.lpad(F.col("turn").cast("string"), 10, "0")).alias("crop")


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(crop, page, position, width, height): a manifest for the turns."""
    return table(spark, sf_dir, "conversations").select(
        crop_id(), F.concat_ws(".", "role", F.expr("conv_id div 8")).alias("page"),
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("position"),
        (8 * F.char_length("text") + 40 * (F.col("conv_id") % 7)).cast("int").alias("width"),
        F.when(F.col("turn") == 7, 0).otherwise(64).alias("height"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, frame, log_probs, label): log-softmax of the scaled embeddings."""
    scaled = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("line_id"), (F.col("vec_id") % 10).cast("int").alias("frame"), "label",
        F.transform("embedding", lambda x: x.cast("double") * 20.0).alias("x"))
    spread = scaled.withColumn("top", F.array_max("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    summed = spread.withColumn("lse", F.col("top") + F.log(total))
    return summed.select("line_id", "frame", F.transform("x", lambda v: v - F.col("lse")).alias("log_probs"), "label")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, targets): the vectors' labels in frame order, repeats merged."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("line_id"), "vec_id", (F.col("label") + 1).alias("symbol"))
    before = rows.select((F.col("vec_id") + 1).alias("vec_id"), "line_id", F.col("symbol").alias("prev"))
    changed = rows.join(before, ["vec_id", "line_id"], "left").where("prev is null or prev <> symbol")
    return changed.groupBy("line_id").agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "symbol")))["symbol"].alias("targets"))


def mixed_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`truth` with lines of every kind: of seven, one has no targets, one too many, one a class that no frame has."""
    t, kind = F.col("targets"), F.col("line_id") % 7
    return truth(spark, sf_dir).select("line_id", F.when(kind == 1, F.lit(None)).when(kind == 2, F.flatten(F.array_repeat(t, 11)))
                                       .when(kind == 3, F.array_append(t, F.lit(999))).otherwise(t).alias("targets"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_pos, path, width, height, sharpness, contrast, brightness, lang)."""
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file_pos"), url,
        F.regexp_extract(url, r"://([^/]*)/", 1).alias("host"),
        F.regexp_extract(url, r"/([a-z]+)/\d", 1).alias("lang"),
        F.regexp_extract(url, r"/[a-z]+/(\d+)", 1).alias("num"), F.char_length("html").alias("size"))
    copy = F.when(url.contains("?"), F.lit("(1)")).otherwise(F.lit(""))
    folder = F.when(F.col("host").startswith("m."), F.lit("dataset/hd_images/")).otherwise(F.lit("dataset/std/"))
    return rows.select(
        "file_pos", F.concat(folder, F.substring("num", 1, 1), F.lit("."), "num", copy, F.lit(".jpg")).alias("path"),
        F.when(~F.col("host").contains("casino"), F.char_length("host")).alias("width"),
        F.char_length(url).alias("height"), (F.col("size") % 90).cast("double").alias("sharpness"),
        (F.col("size") % 50).cast("double").alias("contrast"), (F.col("size") % 256).cast("double").alias("brightness"),
        "lang", F.when(~F.col("host").startswith("free"), (F.col("size") % 12)).alias("n_lines"))


def kannada(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, kn): documents typed into Kannada script, then cleaned."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    typed = docs.select("doc_id", "lang", to_clean_kannada("text").alias("kn"))
    return once(typed, ["doc_id", "lang"], kn=F.col("kn"))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, packed): symbols of `kannada`; for one use of the column, which the rules before and behind it then share a task's worker with."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select("doc_id", encode_packed(to_clean_kannada("text"), digits=True).alias("packed"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`coded` for filters and several uses."""
    return once(coded(spark, sf_dir), ["doc_id"], packed=F.col("packed"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core for heavy text work on a small input.

    A scan with at least as many splits as cores is left alone, so large
    tables are never moved by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


# ---- the same views for the check -----------------------------------------

# The check's levenshtein counts bytes; accented letters of the tables get
# unused one-byte codes first.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CODES = [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24]
ONE_BYTE = "concat(" + ", ".join(f"chr({c})" for c in _CODES) + ")"


def bytes_of(c: str) -> str:
    return f"translate({c}, '{ACCENTED}', {ONE_BYTE})"


def lev(a: str, b: str) -> str:
    return f"levenshtein({bytes_of(a)}, {bytes_of(b)})"


def agreement(a: str, b: str) -> str:
    return (f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 "
            f"ELSE {lev(a, b)}::DOUBLE / greatest(length({a}), length({b})) END")


def cer_sql(ref: str, hyp: str) -> str:
    return f"CASE WHEN length({ref}) = 0 THEN length({hyp})::DOUBLE ELSE {lev(ref, hyp)}::DOUBLE / length({ref}) END"


VIEWS = {
    "pairs": ([], """
        SELECT u.conv_id * 1000000 + u.turn AS pair_id, u.text AS old_text, a.text AS modern_text
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'"""),
    "readings": ([], """
        SELECT item_id AS crop, i AS sample_idx,
               CASE i WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN replace(text, 'th', 'd')
                      WHEN 3 THEN 'x ' || text WHEN 4 THEN replace(text, 'on', 'o') ELSE '  ' END AS text
        FROM benchmark, range(6) r(i)"""),
    "known_readings": ([], """
        SELECT item_id AS crop, i AS sample_idx,
               CASE i WHEN 2 THEN replace(t, 'e', '#') WHEN 3 THEN replace(t, 'a', '@')
                      WHEN 4 THEN replace(replace(t, 'e', '#'), 'a', '@') ELSE t END AS text
        FROM (SELECT item_id, translate(text, '#@', '  ') AS t FROM benchmark), range(6) r(i)"""),
    "label_rows": ([], """
        SELECT * FROM (
          SELECT lpad(conv_id::VARCHAR, 19, '0') || '_' || lpad(turn::VARCHAR, 10, '0') AS crop, l AS labeller,
            CASE l WHEN 'alpha' THEN CASE WHEN role = 'system' THEN ' ' || regexp_replace(text, '[A-Za-z]', '', 'g') ELSE text END
                   WHEN 'beta' THEN CASE WHEN role <> 'system' THEN replace(replace(text, 'eau', 'o'), 'en', '') END
                   ELSE CASE WHEN role = 'assistant' THEN replace(text, 'e', '') END END AS text
          FROM conversations, (VALUES ('alpha'), ('beta'), ('gamma')) v(l)) WHERE text IS NOT NULL"""),
    "crops": ([], """
        SELECT lpad(conv_id::VARCHAR, 19, '0') || '_' || lpad(turn::VARCHAR, 10, '0') AS crop, role || '.' || (conv_id // 8) AS page,
               conv_id * 1000000 + turn AS position, 8 * length(text) + 40 * (conv_id % 7) AS width,
               CASE WHEN turn = 7 THEN 0 ELSE 64 END AS height
        FROM conversations"""),
    "frames": ([], """
        SELECT line_id, frame, label, list_transform(x, lambda v: v - (top + ln(list_sum(
                 list_transform(x, lambda w: exp(w - top)))))) AS lp
        FROM (SELECT *, list_max(x) AS top FROM (
          SELECT vec_id // 10 AS line_id, vec_id % 10 AS frame, label,
                 list_transform(embedding, lambda v: v::DOUBLE * 20.0) AS x FROM embeddings))"""),
    "truth": ([], """
        SELECT line_id, list(symbol ORDER BY vec_id) AS targets FROM (
          SELECT vec_id // 10 AS line_id, vec_id, label + 1 AS symbol,
                 lag(label + 1) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS prev FROM embeddings)
        WHERE prev IS NULL OR prev <> symbol GROUP BY line_id"""),
    "photos": ([], r"""
        SELECT page_id AS file_pos,
               CASE WHEN host LIKE 'm.%' THEN 'dataset/hd_images/' ELSE 'dataset/std/' END || num[1] || '.' || num
                 || CASE WHEN contains(url, '?') THEN '(1)' ELSE '' END || '.jpg' AS path,
               num[1] || '.' || num AS stem, host LIKE 'm.%' AS is_hd,
               CASE WHEN NOT contains(host, 'casino') THEN length(host) END AS width, length(url) AS height,
               (size % 90)::DOUBLE AS sharpness, (size % 50)::DOUBLE AS contrast, (size % 256)::DOUBLE AS brightness,
               lang, CASE WHEN NOT starts_with(host, 'free') THEN size % 12 END AS n_lines
        FROM (SELECT page_id, url, regexp_extract(url, '://([^/]*)/', 1) AS host,
                     regexp_extract(url, '/([a-z]+)/[0-9]', 1) AS lang,
                     regexp_extract(url, '/[a-z]+/([0-9]+)', 1) AS num, length(html) AS size FROM pages)"""),
    **script_sql.VIEWS,
}


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the named views and those they need."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in wanted) + "\n" + body
