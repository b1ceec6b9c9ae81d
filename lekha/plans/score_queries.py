"""Metric, report and consensus queries (sections F, G and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.expr import words
from ..functions.metrics import agreement_cer, cer, edit_distance, symbol_cer
from ..operators import consensus, frames as fr, reports, scoring, splits
from ..operators.dedupe import first_per_signature, one_per_page
from ..operators.ranking import exact_percentiles
from ..session import stored
from .adapters import agreement, cer_sql, frames, known_readings, kannada, lev, pairs, photos, readings, spread, table, truth, with_views
from .registry import query
from .text_queries import hash_sql, tokens


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- flagship ---------------------------------------------------------------------


@query("flagship_scored_pairs", with_views(f"""
    SELECT is_test, count(*) AS n, round(avg(d), 6) AS mean, round(min(d), 6) AS min, round(max(d), 6) AS max,
           count(*) FILTER (WHERE d <= 0.35) AS n_within, round(median(d), 6) AS median FROM (
      SELECT {hash_sql('s2', 'pair_id', 38)} AS is_test, {cer_sql('o', 'm')} AS d FROM (
        SELECT pair_id, trim(regexp_replace(old_text, '\\s+', ' ', 'g')) AS o,
               trim(regexp_replace(modern_text, '\\s+', ' ', 'g')) AS m FROM pairs)
      WHERE length(o) > 0 AND length(m) / length(o) BETWEEN 0.7 AND 1.5) GROUP BY is_test""", "pairs"))
def flagship(spark, sf_dir):
    """Clean the pairs, keep the length band, split by hash, score by split."""
    cleaned = pairs(spark, sf_dir).select(
        "pair_id", text.clean_modern("old_text").alias("old"), text.clean_modern("modern_text").alias("new"))
    usable = cleaned.where(text.in_band("old", "new"))
    scored = splits.hash_split(usable, "pair_id", "s2", 38).select("is_test", cer("old", "new").alias("cer"))
    # The distances cost most, and the summary reads them more than once.
    scored = stored(scored, "scores")
    return rounded(scoring.score_summary(scored, "cer", group=["is_test"]), "mean", "min", "max", "median")


# ---- G: pairwise metrics -------------------------------------------------------------


@query("g1_edit_distance", with_views(f"SELECT pair_id, {lev('old_text', 'modern_text')} AS distance FROM pairs", "pairs"))
def g1(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", edit_distance("old_text", "modern_text").alias("distance"))


@query("g2_cer", with_views(f"SELECT pair_id, round({cer_sql('old_text', 'modern_text')}, 6) AS cer FROM pairs", "pairs"))
def g2(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", F.round(cer("old_text", "modern_text"), 6).alias("cer"))


@query("g3_agreement_cer", with_views(
    f"SELECT pair_id, round({agreement('old_text', 'modern_text')}, 6) AS d FROM pairs", "pairs"))
def g3(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", F.round(agreement_cer("old_text", "modern_text"), 6).alias("d"))


_ARGMAX = "list_position(lp, list_max(lp)) - 1"
_DECODED = f"""
    decoded AS (SELECT line_id, list(cls ORDER BY frame) FILTER (WHERE cls <> 0 AND cls IS DISTINCT FROM prev) AS ids FROM (
      SELECT line_id, frame, cls, lag(cls) OVER (PARTITION BY line_id ORDER BY frame) AS prev FROM (
        SELECT line_id, frame, {_ARGMAX} AS cls FROM frames)) GROUP BY line_id)"""


def decoded_sql(body: str, *views: str) -> str:
    return with_views("", "frames", *views).rstrip() + "," + _DECODED + body


@query("g4_symbol_cer", decoded_sql("""
    SELECT t.line_id, round(levenshtein(
        array_to_string(list_transform(targets, lambda x: chr(x::INT + 32)), ''),
        array_to_string(list_transform(coalesce(ids, []), lambda x: chr(x::INT + 32)), ''))::DOUBLE / len(targets), 6) AS cer
    FROM truth t JOIN decoded d ON d.line_id = t.line_id""", "truth"))
def g4(spark, sf_dir):
    read = fr.greedy_decode(frames(spark, sf_dir))
    both = truth(spark, sf_dir).join(read, "line_id")
    return both.select("line_id", F.round(symbol_cer("targets", "indices", 96), 6).alias("cer"))


_GRAMS = """
    grams AS (
      SELECT sys, id, n, side, substr(t, i, n) AS gram FROM (
        SELECT sys, id, side, n, t, unnest(range(1, length(t) - n + 2)) AS i FROM sides_packed, range(1, 7) r(n))
      UNION ALL
      SELECT sys, id, 6 + n, side, array_to_string(w[i:i + n - 1], chr(1)) FROM (
        SELECT sys, id, side, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sides_words, range(1, 3) r(n))),
    counted AS (SELECT sys, id, n, gram, count(*) FILTER (WHERE side = 'h') AS h, count(*) FILTER (WHERE side = 'r') AS r
                FROM grams GROUP BY ALL),
    per_row AS (SELECT sys, id, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM counted GROUP BY sys, id, n),
    stats AS (SELECT sys, n, sum(CASE WHEN r > 0 THEN h ELSE 0 END) AS h, sum(r) AS r, sum(m) AS m FROM per_row GROUP BY sys, n),
    chrf AS (SELECT sys, CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0 END AS chrf FROM (
      SELECT sys, coalesce(avg(m / h) FILTER (WHERE h > 0 AND r > 0), 0) AS p,
             coalesce(avg(m / r) FILTER (WHERE h > 0 AND r > 0), 0) AS q FROM stats GROUP BY sys))"""
_SIDES = """
    sides AS (SELECT sys, id, 'h' AS side, hyp AS t FROM scored UNION ALL SELECT sys, id, 'r', ref FROM scored),
    sides_packed AS (SELECT sys, id, side, regexp_replace(t, '\\s+', '', 'g') AS t FROM sides),
    sides_words AS (SELECT sys, id, side, list(p ORDER BY k, j) FILTER (WHERE p <> '') AS w FROM (
      SELECT sys, id, side, k, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (
        SELECT sys, id, side, k, CASE
            WHEN length(x) = 1 THEN [x]
            WHEN regexp_matches(x, '[!-/:-@\\[-`{-~]$') THEN [x[:-2], x[-1]]
            WHEN regexp_matches(x, '^[!-/:-@\\[-`{-~]') THEN [x[1], x[2:]] ELSE [x] END AS ps FROM (
          SELECT sys, id, side, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (
            SELECT sys, id, side, regexp_extract_all(t, '\\S+') AS l FROM sides)))) GROUP BY sys, id, side)"""
_BLEU = """
    toks AS (SELECT sys, id, side, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        ' ' || replace(replace(replace(replace(replace(replace(t, '-' || chr(10), ''), chr(10), ' '), '&quot;', '"'),
        '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
        '([{-~\\[-` -&(-+:-@/])', ' \\1 ', 'g'), '([^0-9])([.,])', '\\1 \\2 ', 'g'),
        '([.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g'), '\\S+') AS w FROM sides),
    bgrams AS (SELECT sys, id, side, n, array_to_string(w[i:i + n - 1], chr(1)) AS gram FROM (
      SELECT sys, id, side, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM toks, range(1, 5) r(n))),
    bcounted AS (SELECT sys, id, n, gram, count(*) FILTER (WHERE side = 'h') AS h, count(*) FILTER (WHERE side = 'r') AS r
                 FROM bgrams GROUP BY ALL),
    bstats AS (SELECT sys, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM bcounted GROUP BY sys, n),
    bleu AS (SELECT s.sys, CASE WHEN min(s.h) > 0 AND max(s.m) > 0 AND count(*) = 4 THEN
        100 * CASE WHEN any_value(o.h) < any_value(o.r) THEN exp(1 - any_value(o.r) / any_value(o.h)) ELSE 1 END
        * exp(avg(ln(CASE WHEN s.m > 0 THEN s.m / s.h ELSE 1 / (2 ** s.misses * s.h) END))) ELSE 0 END AS bleu
      FROM (SELECT *, count(*) FILTER (WHERE m = 0) OVER (PARTITION BY sys ORDER BY n) AS misses FROM bstats) s
      JOIN (SELECT sys, h, r FROM bstats WHERE n = 1) o ON o.sys = s.sys GROUP BY s.sys)"""
_ONE = "scored AS (SELECT 'x' AS sys, pair_id AS id, old_text AS hyp, modern_text AS ref FROM pairs)"
_SYSTEMS = """scored AS (SELECT sys, pair_id AS id, modern_text AS ref, CASE sys WHEN 'unchanged' THEN old_text
      WHEN 'softened' THEN replace(modern_text, 'th', 'd') ELSE replace(modern_text, 'e', 'a') END AS hyp
    FROM pairs, (VALUES ('unchanged'), ('softened'), ('vowels')) v(sys))"""


def score_sql(scored: str, parts: list[str], body: str) -> str:
    return with_views("", "pairs").rstrip() + ",\n    " + ",\n".join([scored, *parts]) + body


@query("g5_chrf", score_sql(_ONE, [_SIDES, _GRAMS], " SELECT round(chrf, 6) AS chrf FROM chrf"))
def g5(spark, sf_dir):
    return rounded(scoring.chrf_plus_plus(pairs(spark, sf_dir), "modern_text", "old_text"), "chrf")


@query("g6_bleu", score_sql(_ONE, [_SIDES, _BLEU], " SELECT round(bleu, 6) AS bleu FROM bleu"))
def g6(spark, sf_dir):
    return rounded(scoring.bleu(pairs(spark, sf_dir), "modern_text", "old_text"), "bleu")


def systems(spark, sf_dir):
    m = F.col("modern_text")
    hyps = F.array(*[F.struct(F.lit(n).alias("system"), h.alias("hyp")) for n, h in (
        ("unchanged", F.col("old_text")), ("softened", F.replace(m, F.lit("th"), F.lit("d"))), ("vowels", F.replace(m, F.lit("e"), F.lit("a"))))])
    return pairs(spark, sf_dir).select("pair_id", F.col("modern_text").alias("ref"), F.inline(hyps))


@query("f20_system_comparison", score_sql(_SYSTEMS, [_SIDES, _GRAMS, _BLEU], """
    SELECT c.sys AS system, round(c.chrf, 6) AS chrf, round(b.bleu, 6) AS bleu, z.n, round(z.hc, 6) AS mean_hyp_chars,
           round(z.rc, 6) AS mean_ref_chars, round(c.chrf - (SELECT chrf FROM chrf WHERE sys = 'unchanged'), 6) AS chrf_gain
    FROM chrf c JOIN bleu b ON b.sys = c.sys JOIN (
      SELECT sys, count(*) AS n, avg(length(hyp)) AS hc, avg(length(ref)) AS rc FROM scored GROUP BY sys) z ON z.sys = c.sys"""))
def f20(spark, sf_dir):
    out = scoring.compare_systems(systems(spark, sf_dir), "ref", "hyp", "system", "unchanged")
    return rounded(out, "chrf", "bleu", "mean_hyp_chars", "mean_ref_chars", "chrf_gain")


def _aligned(spark, sf_dir):
    return scoring.aligned_pairs(pairs(spark, sf_dir), ["pair_id"], "old_text", "modern_text")


@query("g7_alignment_costs", with_views(f"""
    SELECT pair_id, {lev('old_text', 'modern_text')} AS edits, length(old_text) AS ref_chars, length(modern_text) AS hyp_chars
    FROM pairs WHERE old_text || modern_text <> ''""", "pairs"))
def g7(spark, sf_dir):
    """Edits, reference and hypothesis characters counted from the aligned positions."""
    same = F.coalesce(F.col("ref_ch") == F.col("hyp_ch"), F.lit(False))
    return _aligned(spark, sf_dir).groupBy("pair_id").agg(
        F.count_if(~same).alias("edits"), F.count("ref_idx").alias("ref_chars"), F.count("hyp_idx").alias("hyp_chars"))


@query("g7_aligned_positions")
def g7_positions(spark, sf_dir):
    return scoring.aligned_pairs(_reading_pairs(spark, sf_dir), ["crop", "sample_idx"], "gold", "text")


def _reading_pairs(spark, sf_dir):
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("crop"), F.col("text").alias("gold"))
    return readings(spark, sf_dir).join(gold, "crop")


@query("g8_confusions")
def g8(spark, sf_dir):
    return scoring.confusion_counts(_aligned(spark, sf_dir))


# Where a reading equals its passage with every "e" read as "c", the edits are
# known without an alignment, which gives G8 and G9 an independent check.
@query("g8_known_confusions", """
    SELECT 'e' AS ref_ch, 'c' AS hyp_ch, sum(length(text) - length(replace(text, 'e', ''))) AS n FROM benchmark""")
def g8_known(spark, sf_dir):
    """Passages read with one letter confused: only that confusion appears."""
    rows = table(spark, sf_dir, "benchmark")
    both = rows.select("item_id", "text", F.replace("text", F.lit("e"), F.lit("c")).alias("hyp"))
    found = scoring.confusion_counts(scoring.aligned_pairs(both, ["item_id"], "text", "hyp"))
    return found.where("ref_ch <> hyp_ch")


@query("g9_correction_variants", f"""
    WITH p AS (SELECT text AS g, replace(text, 'e', 'c') AS m FROM benchmark),
      v AS (SELECT 'as_typed' AS variant, {agreement('g', 'm')} AS d FROM p
            UNION ALL SELECT 'machine_agreed', 0.0 FROM p UNION ALL SELECT 'blanket', 0.0 FROM p)
    SELECT variant, round(avg(d), 6) AS mean_cer, round(median(d), 6) AS median_cer FROM v GROUP BY variant""")
def g9(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.replace("text", F.lit("e"), F.lit("c")).alias("hyp"))
    out = scoring.correction_variants(rows, ["item_id"], "text", "hyp", "e", "c")
    return rounded(out, "mean_cer", "median_cer")


@query("g10_sample_recovery", """
    SELECT item_id AS crop, n AS consensus_wrong, n AS some_sample_right FROM (
      SELECT item_id, length(text) - length(replace(text, 'e', '')) AS n FROM benchmark)""")
def g10(spark, sf_dir):
    """A consensus with one letter wrong throughout; two of the readings have it right."""
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("crop"), "text")
    wrong = gold.withColumn("text", F.replace("text", F.lit("e"), F.lit("c")))
    return scoring.sample_recovery(gold, wrong, readings(spark, sf_dir), "crop")


@query("g12_position_accuracy", """
    SELECT count(*) AS n, round(avg((p = t)::INT), 6) AS accuracy FROM (
      SELECT unnest(string_split(replace(text, 'e', 'a'), '')) AS p, unnest(string_split(text, '')) AS t FROM documents)
    WHERE t <> ' '""")
def g12(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.transform(F.split(F.replace("text", F.lit("e"), F.lit("a")), ""), F.ascii).alias("p"),
        F.transform(F.split("text", ""), F.ascii).alias("t"))
    return rounded(scoring.position_accuracy(rows, "p", "t", ord(" ")), "accuracy")


@query("g13_mean_cer", with_views(f"""
    SELECT round(avg({cer_sql('old_text', 'modern_text')}), 5) AS mean_cer, count(*) AS n FROM pairs""", "pairs"))
def g13(spark, sf_dir):
    return pairs(spark, sf_dir).agg(
        F.round(F.avg(cer("old_text", "modern_text")), 5).alias("mean_cer"), F.count(F.lit(1)).alias("n"))


@query("g_paired_refs_and_hyps", with_views("SELECT pair_id, length(old_text) AS a, length(modern_text) AS b FROM pairs", "pairs"))
def g_paired(spark, sf_dir):
    """References joined to hypotheses with the no-missing-row check."""
    rows = pairs(spark, sf_dir)
    both = scoring.paired(rows.select("pair_id", "old_text"), rows.select("pair_id", "modern_text"), ["pair_id"])
    return both.select("pair_id", F.char_length("old_text").alias("a"), F.char_length("modern_text").alias("b"))


# ---- F: reports ----------------------------------------------------------------------


@query("f3_score_summary", with_views(f"""
    SELECT count(*) AS n, round(avg(d), 6) AS mean, round(min(d), 6) AS min, round(max(d), 6) AS max,
           count(*) FILTER (WHERE d <= 0.35) AS n_within, round(median(d), 6) AS median
    FROM (SELECT {agreement('old_text', 'modern_text')} AS d FROM pairs)""", "pairs"))
def f3(spark, sf_dir):
    scored = pairs(spark, sf_dir).select(agreement_cer("old_text", "modern_text").alias("d"))
    return rounded(scoring.score_summary(stored(scored, "scores"), "d"), "mean", "min", "max", "median")


@query("f7_letter_counts", """
    SELECT source, l AS letter, sum(len(string_split(text, l)) - 1) AS total, count(*) FILTER (WHERE contains(text, l)) AS lines
    FROM documents, (VALUES ('é'), ('ß')) v(l) GROUP BY source, l""")
def f7(spark, sf_dir):
    return reports.letter_counts(spread(table(spark, sf_dir, "documents"), "doc_id"), "text", ["é", "ß"], "source")


@query("f8_tag_counts", """
    SELECT tag, count(*) AS n FROM (SELECT role AS tag, unnest(regexp_extract_all(text, '\\S+')) FROM conversations) GROUP BY tag""")
def f8(spark, sf_dir):
    return reports.value_counts(tokens(spark, sf_dir), "tag")


@query("f8_map_totals", """
    SELECT name, sum(n) AS n FROM (SELECT 'chars' AS name, n_chars AS n FROM documents UNION ALL
      SELECT lang, 1 FROM documents) GROUP BY name""")
def f8_maps(spark, sf_dir):
    counts = F.create_map(F.lit("chars"), F.col("n_chars"), F.col("lang"), F.lit(1).cast("bigint"))
    return reports.map_totals(table(spark, sf_dir, "documents").select(counts.alias("class_counts")), "class_counts")


@query("f9_success_rates", with_views("""
    SELECT 'photo' AS unit, count(*) AS n, count(*) FILTER (WHERE coalesce(n_lines, 0) > 0) AS n_ok,
           round(avg((coalesce(n_lines, 0) > 0)::INT), 6) AS rate FROM (
      SELECT *, row_number() OVER (PARTITION BY width, height, sharpness, contrast, brightness ORDER BY file_pos) AS r
      FROM photos WHERE width IS NOT NULL) WHERE r = 1
    UNION ALL SELECT 'page', count(*), count(*) FILTER (WHERE coalesce(n_lines, 0) > 0), round(avg((coalesce(n_lines, 0) > 0)::INT), 6)
    FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY is_hd, file_pos) AS r FROM photos) WHERE r = 1""", "photos"))
def f9(spark, sf_dir):
    rows = photos(spark, sf_dir)
    ok = F.coalesce("n_lines", F.lit(0)) > 0
    return rounded(reports.success_rates(first_per_signature(rows), one_per_page(rows), ok), "rate")


@query("f10_ratio_distribution", with_views("""
    SELECT count(r) AS n, round(median(r), 6) AS median, round(quantile_cont(r, 0.9), 6) AS p90, round(max(r), 6) AS max
    FROM (SELECT length(modern_text) / length(old_text) AS r FROM pairs WHERE length(old_text) > 0)""", "pairs"))
def f10(spark, sf_dir):
    ratios = pairs(spark, sf_dir).select(text.length_ratio("old_text", "modern_text").alias("r"))
    return rounded(reports.ratio_distribution(ratios, "r"), "median", "p90", "max")


@query("f11_split_by_band", with_views(f"""
    SELECT coalesce(is_test::VARCHAR, 'all') AS split, count(*) AS n, count(*) FILTER (WHERE b) AS n_in_band FROM (
      SELECT {hash_sql('s2', 'pair_id', 38)} AS is_test, length(modern_text) / length(old_text) BETWEEN 0.7 AND 1.5 AS b FROM pairs)
    GROUP BY CUBE (is_test)""", "pairs"))
def f11(spark, sf_dir):
    rows = splits.hash_split(pairs(spark, sf_dir), "pair_id", "s2", 38).withColumn(
        "in_band", text.in_band("old_text", "modern_text"))
    out = reports.split_by_band(rows, "is_test", "in_band")
    return out.select(F.coalesce(F.col("is_test").cast("string"), F.lit("all")).alias("split"), "n", "n_in_band")


@query("f14_scaling_fit", with_views(f"""
    SELECT count(*) AS points, round(regr_slope(d, log2(length(old_text))), 6) AS slope,
           round(regr_intercept(d, log2(length(old_text))), 6) AS intercept
    FROM (SELECT *, {agreement('old_text', 'modern_text')} AS d FROM pairs)""", "pairs"))
def f14(spark, sf_dir):
    """Disagreement against the logarithm of the prompt length."""
    points = pairs(spark, sf_dir).select(
        F.char_length("old_text").alias("n"), agreement_cer("old_text", "modern_text").alias("score"))
    return rounded(reports.scaling_fit(points, "n", "score"), "slope", "intercept")


_OVERLAP = """
    items AS (
      SELECT pair_id, 'word' AS kind, side, unnest(w) AS item FROM sw
      UNION ALL SELECT pair_id, 'stem', side, unnest(list_transform(list_filter(w, lambda x: length(x) >= 4), lambda x: substr(x, 1, 4))) FROM sw
      UNION ALL SELECT pair_id, 'gram', side, substr(t, i, 4) FROM (SELECT *, unnest(range(1, length(t) - 2)) AS i FROM sw)),
    counted AS (SELECT pair_id, kind, item, count(*) FILTER (WHERE side = 't') AS n, bool_or(side = 's') AS shared
                FROM items GROUP BY ALL)
    SELECT kind, sum(n) AS n_target, sum(CASE WHEN shared THEN n ELSE 0 END) AS n_shared,
           round(sum(CASE WHEN shared THEN n ELSE 0 END) / sum(n), 6) AS share FROM counted GROUP BY kind"""


@query("f15_overlap", with_views("", "pairs").rstrip() + """,
    sw AS (SELECT pair_id, 's' AS side, old_text AS t, regexp_extract_all(old_text, '\\S+') AS w FROM pairs
           UNION ALL SELECT pair_id, 't', modern_text, regexp_extract_all(modern_text, '\\S+') FROM pairs),""" + _OVERLAP)
def f15(spark, sf_dir):
    return rounded(reports.overlap_report(pairs(spark, sf_dir), "old_text", "modern_text"), "share")


@query("f16_repetition", """
    SELECT lang, count(*) AS n, round(avg(1 - len(list_distinct(w)) / len(w)), 5) AS mean_repetition
    FROM (SELECT lang, regexp_extract_all(text, '\\S+') AS w FROM documents) GROUP BY lang""")
def f16(spark, sf_dir):
    out = reports.repetition_report(spread(table(spark, sf_dir, "documents"), "doc_id"), "text", ["lang"])
    return rounded(out, "mean_repetition", digits=5)


@query("f17_rule_firings", with_views("""
    SELECT rule, coalesce(sum(n), 0) AS firings, count(*) FILTER (WHERE n > 0) AS lines FROM (
      SELECT doc_id, rule, count(*) FILTER (WHERE ch = 'ಂ' AND contains(stops, nx)) AS n
      FROM (SELECT doc_id, ch, coalesce(lead(ch) OVER (PARTITION BY doc_id ORDER BY pos), ' ') AS nx FROM (
              SELECT doc_id, unnest(cs) AS ch, generate_subscripts(cs, 1) AS pos FROM (
                SELECT doc_id, string_split(replace(kn, 'ನ್', 'ಂ'), '') AS cs FROM kannada WHERE kn <> ''))),
           (VALUES ('nasal ಙ', 'ಕಖಗಘ'), ('nasal ಞ', 'ಚಛಜಝ'), ('nasal ಣ', 'ಟಠಡಢ'), ('nasal ನ', 'ತಥದಧ'), ('nasal ಮ', 'ಪಫಬಭ')) v(rule, stops)
      GROUP BY doc_id, rule) GROUP BY rule""", "kannada"))
def f17(spark, sf_dir):
    rows = kannada(spark, sf_dir).select(F.replace("kn", F.lit("ನ್"), F.lit("ಂ")).alias("t"))
    return reports.rule_firings(rows, "t").where(F.col("rule").startswith("nasal")).select("rule", "firings", "lines")


@query("f18_vocabulary_share", """
    WITH vocab AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\S+')) AS word FROM benchmark)
    SELECT role, count(*) AS n_words, count(v.word) AS n_known, round(count(v.word) / count(*), 6) AS share
    FROM (SELECT role, unnest(regexp_extract_all(text, '\\S+')) AS word FROM conversations) t
    LEFT JOIN vocab v ON v.word = t.word GROUP BY role""")
def f18(spark, sf_dir):
    vocab = table(spark, sf_dir, "benchmark").select(F.explode(words("text")).alias("word"))
    return rounded(reports.vocabulary_share(table(spark, sf_dir, "conversations"), "text", vocab, ["role"]), "share")


@query("f22_paired_comparison", with_views(f"""
    SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, count(*) FILTER (WHERE b < a) AS n_b_better,
           round(avg(b) - avg(a), 6) AS difference, round(median(a), 6) AS median_a, round(median(b), 6) AS median_b FROM (
      SELECT {agreement('g', 'r2')} AS a, {agreement('g', 'r4')} AS b FROM (
        SELECT text AS g, replace(text, 'th', 'd') AS r2, replace(text, 'on', 'o') AS r4 FROM benchmark))""", "readings"))
def f22(spark, sf_dir):
    """The two kinds of damaged reading against the passage."""
    d = agreement_cer("gold", "text")
    wide = _reading_pairs(spark, sf_dir).groupBy("crop").agg(
        F.max(F.when(F.col("sample_idx") == 2, d)).alias("a"), F.max(F.when(F.col("sample_idx") == 4, d)).alias("b"))
    return rounded(scoring.paired_comparison(stored(wide, "arms"), "a", "b"),
                   "mean_a", "mean_b", "difference", "median_a", "median_b")


@query("f24_review_accuracy", """
    SELECT count(*) FILTER (WHERE toxic = 0) AS n_reviewed, round(avg(quality) FILTER (WHERE toxic = 0), 6) AS accuracy FROM labels""")
def f24(spark, sf_dir):
    mark = F.when(F.col("toxic") == 1, "").when(F.col("quality") == 1, "y").otherwise("n")
    return rounded(reports.review_accuracy(table(spark, sf_dir, "labels").select(mark.alias("correct"))), "accuracy")


@query("f25_best_epoch", """
    WITH h AS (SELECT lang AS run, substr(source, 4)::INT AS epoch, avg(n_chars) AS score FROM documents GROUP BY ALL)
    SELECT run, count(*) AS n_epochs, arg_min(epoch, score) FILTER (WHERE epoch % 5 <> 0) AS best_epoch,
           round(min(score) FILTER (WHERE epoch % 5 <> 0), 6) AS best_score FROM h GROUP BY run""")
def f25(spark, sf_dir):
    """Languages as runs, sources as epochs; every fifth epoch diverged to NaN."""
    epoch = F.substring("source", 4, 9).cast("int")
    history = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("run"), epoch.alias("epoch")).agg(
        F.avg("n_chars").alias("score")).withColumn(
        "score", F.when(F.col("epoch") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("score")))
    return rounded(reports.best_epochs(history, "run", "epoch", "score"), "best_score")


@query("f26_class_prevalence", """
    SELECT lang, rule, sum(n) AS firings, count(*) FILTER (WHERE n > 0) AS lines, round(sum(n) / sum(length(text)), 8) AS char_share,
           round(count(*) FILTER (WHERE n > 0) / count(*), 6) AS line_share FROM (
      SELECT lang, rule, text, len(regexp_extract_all(text, pattern)) AS n FROM documents,
        (VALUES ('digit', '[0-9]'), ('capital', '[A-Z]')) v(rule, pattern)) GROUP BY lang, rule""")
def f26(spark, sf_dir):
    out = reports.pattern_report(spread(table(spark, sf_dir, "documents"), "doc_id"), "text", {"digit": "[0-9]", "capital": "[A-Z]"}, ["lang"])
    return out.withColumn("char_share", F.round("char_share", 8)).withColumn("line_share", F.round("line_share", 6))


@query("f27_run_deltas", """
    SELECT lang, round(b.m - a.m, 6) AS delta_mean_chars, b.n - a.n AS delta_n FROM
      (SELECT lang, avg(n_chars) AS m, count(*) AS n FROM documents GROUP BY lang) a JOIN
      (SELECT lang, avg(n_chars) AS m, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang) b USING (lang)""")
def f27(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    stats = [F.avg("n_chars").alias("mean_chars"), F.count(F.lit(1)).alias("n")]
    a = rows.groupBy("lang").agg(*stats)
    b = rows.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(*stats)
    return rounded(reports.run_deltas(a, b, ["lang"], ["mean_chars", "n"]), "delta_mean_chars")


# ---- I: consensus -------------------------------------------------------------------------

_CONSENSUS = f"""
    live AS (SELECT * FROM readings WHERE trim(text) <> ''),
    dist AS (SELECT a.crop, a.sample_idx, a.text, coalesce(round(sum({agreement('a.text', 'b.text')}), 9), 0) AS total
             FROM live a LEFT JOIN live b ON a.crop = b.crop AND a.sample_idx <> b.sample_idx GROUP BY ALL),
    base AS (SELECT crop, arg_min(text, (total, sample_idx)) AS base, count(*) AS n FROM dist GROUP BY crop)"""


def consensus_sql(body: str) -> str:
    return with_views("", "readings").rstrip() + "," + _CONSENSUS + body


def _slots(spark, sf_dir):
    rows = readings(spark, sf_dir)
    bases = consensus.medoids(rows)
    votes = consensus.position_votes(rows, bases)
    return rows, bases, consensus.consensus_slots(votes)


@query("i1_medoid", consensus_sql(" SELECT crop, base, n FROM base"))
def i1(spark, sf_dir):
    return consensus.medoids(readings(spark, sf_dir))


@query("i2_position_votes", consensus_sql("""
    SELECT crop, n * length(base) AS votes, length(base) AS positions FROM base"""))
def i2(spark, sf_dir):
    """Every reading votes exactly once at every base position."""
    rows = readings(spark, sf_dir)
    votes = consensus.position_votes(rows, consensus.medoids(rows))
    return votes.groupBy("crop").agg(F.sum("votes").alias("votes"), F.count_distinct("pos").alias("positions"))


@query("i3_uncertain_slots")
def i3(spark, sf_dir):
    _, _, slots = _slots(spark, sf_dir)
    unsure = consensus.uncertain_slots(slots)
    alternatives = F.transform("alternatives", lambda a: F.format_string("%s:%.3f", a["char"], a["prob"]))
    return unsure.select("crop", "pos", "chosen", F.round("agreement", 3).alias("agreement"),
                         F.array_join(alternatives, " ").alias("alternatives"))


@query("i4_variant_lines")
def i4(spark, sf_dir):
    _, bases, slots = _slots(spark, sf_dir)
    return consensus.variant_lines(bases, consensus.uncertain_slots(slots))


@query("i5_annotated_block")
def i5(spark, sf_dir):
    _, bases, slots = _slots(spark, sf_dir)
    variants = consensus.variant_lines(bases, consensus.uncertain_slots(slots))
    return fr.annotated_blocks(variants, fr.UNDECIDED_READ, "crop", max_rivals=4, least=0.0)


@query("i6_sample_disagreement", with_views(f"""
    SELECT a.crop, round(avg({agreement('a.text', 'b.text')}), 6) AS mean_disagreement
    FROM readings a JOIN readings b ON a.crop = b.crop AND a.sample_idx < b.sample_idx GROUP BY a.crop""", "readings"))
def i6(spark, sf_dir):
    return rounded(consensus.sample_disagreement(readings(spark, sf_dir)), "mean_disagreement")


@query("i7_branch_divergence", """
    SELECT d.doc_id, coalesce((d.lang <> CASE WHEN l.quality = 1 THEN 'en' WHEN l.quality = 0 THEN 'fr' END)::VARCHAR, 'missing') AS differ
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def i7(spark, sf_dir):
    other = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "en").otherwise("fr").alias("by_quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("by_language")).join(other, "doc_id", "left")
    return consensus.branches_differ(rows, "by_language", "by_quality").select(
        "doc_id", F.coalesce(F.col("branches_differ").cast("string"), F.lit("missing")).alias("differ"))


@query("f21_demo_summary", consensus_sql("""
    SELECT count(*) AS n_lines FROM base WHERE base <> ''"""))
def f21(spark, sf_dir):
    _, bases, slots = _slots(spark, sf_dir)
    slots = stored(slots, "slots")
    per_crop = consensus.consensus_summary(bases, slots, consensus.uncertain_slots(slots)).withColumn(
        "branches_differ", F.col("n_uncertain") > 0)
    return reports.demo_summary(per_crop).select("n_lines")


@query("f21_demo_statistics")
def f21_statistics(spark, sf_dir):
    _, bases, slots = _slots(spark, sf_dir)
    slots = stored(slots, "slots")
    per_crop = consensus.consensus_summary(bases, slots, consensus.uncertain_slots(slots)).withColumn(
        "branches_differ", F.col("n_uncertain") > 0)
    return rounded(reports.demo_summary(per_crop), "mean_fraction_uncertain")


# Readings of one length whose errors are known place by place: votes need no alignment.
_KNOWN = """
    base AS (SELECT crop, text AS base, 6 AS n FROM known_readings WHERE sample_idx = 0 AND trim(text) <> ''),
    votes AS (SELECT crop, pos, n, any_value(b) AS chosen, c, count(*) AS votes FROM (
        SELECT r.crop, i - 1 AS pos, n, substr(base, i, 1) AS b, substr(text, i, 1) AS c FROM (
          SELECT k.crop, k.text, b.base, b.n, unnest(range(1, length(base) + 1)) AS i FROM known_readings k JOIN base b ON b.crop = k.crop) r)
      GROUP BY crop, pos, n, c),
    slots AS (SELECT crop, pos, n, any_value(chosen) AS chosen, max(votes / n) FILTER (WHERE c = chosen) AS agreement,
                     string_agg(printf('%s:%.3f', c, votes / n), ' ' ORDER BY votes DESC, c) AS alternatives FROM votes GROUP BY crop, pos, n),
    swaps AS (SELECT v.crop, v.pos, v.c, round(v.votes / v.n, 3) AS prob,
                     row_number() OVER (PARTITION BY v.crop ORDER BY round(v.votes / v.n, 3) DESC, v.pos DESC, v.c DESC) AS rank
              FROM votes v WHERE v.c <> v.chosen),
    variants AS (SELECT crop, 0 AS rank, base AS text, 1.0::DOUBLE AS prob FROM base UNION ALL
                 SELECT s.crop, rank, substr(base, 1, pos::INT) || c || substr(base, pos::INT + 2), prob FROM swaps s JOIN base b ON b.crop = s.crop WHERE rank <= 4)"""


def known_sql(body: str) -> str:
    return with_views("", "known_readings").rstrip() + "," + _KNOWN + body


def _known_slots(spark, sf_dir):
    rows = known_readings(spark, sf_dir)
    bases = consensus.medoids(rows)
    return bases, consensus.consensus_slots(consensus.position_votes(rows, bases))


@query("i3_known_slots", known_sql("""
    SELECT crop, pos, chosen, round(agreement, 3) AS agreement, alternatives FROM slots WHERE agreement < 1"""))
def i3_known(spark, sf_dir):
    unsure = consensus.uncertain_slots(_known_slots(spark, sf_dir)[1])
    alternatives = F.transform("alternatives", lambda a: F.format_string("%s:%.3f", a["char"], a["prob"]))
    return unsure.select("crop", "pos", "chosen", F.round("agreement", 3).alias("agreement"), F.array_join(alternatives, " ").alias("alternatives"))


@query("i4_known_variants", known_sql(" SELECT crop, rank, text, prob FROM variants"))
def i4_known(spark, sf_dir):
    bases, slots = _known_slots(spark, sf_dir)
    return consensus.variant_lines(bases, consensus.uncertain_slots(slots))


@query("i5_known_block", known_sql(f"""
    SELECT b.crop, 'reading: ' || base || coalesce(chr(10) || '{fr.UNDECIDED_READ}' || chr(10) || rivals, '') AS block FROM base b LEFT JOIN (
      SELECT crop, string_agg('  ' || text || printf('  (%.2f)', prob), chr(10) ORDER BY rank) AS rivals FROM variants WHERE rank >= 1 GROUP BY crop) r
    ON r.crop = b.crop"""))
def i5_known(spark, sf_dir):
    bases, slots = _known_slots(spark, sf_dir)
    variants = consensus.variant_lines(bases, consensus.uncertain_slots(slots))
    return fr.annotated_blocks(variants, fr.UNDECIDED_READ, "crop", max_rivals=4, least=0.0)


@query("f21_known_statistics", known_sql("""
    SELECT count(*) AS n_lines, round(avg(u / c), 6) AS mean_fraction_uncertain, count(*) FILTER (WHERE u > 0) AS n_lines_with_uncertain,
           count(*) FILTER (WHERE u > 40) AS n_branches_differ
    FROM (SELECT crop, count(*) AS c, count(*) FILTER (WHERE agreement < 1) AS u FROM slots GROUP BY crop)"""))
def f21_known(spark, sf_dir):
    bases, slots = _known_slots(spark, sf_dir)
    slots = stored(slots, "slots")
    per_crop = consensus.consensus_summary(bases, slots, consensus.uncertain_slots(slots)).withColumn("branches_differ", F.col("n_uncertain") > 40)
    return rounded(reports.demo_summary(per_crop), "mean_fraction_uncertain")


@query("f10_length_percentiles", """
    SELECT lang, count(*) AS n, round(quantile_cont(length(text), 0.1), 6) AS p10, round(median(length(text)), 6) AS p50,
           round(quantile_cont(length(text), 0.9), 6) AS p90 FROM documents GROUP BY lang""")
def f10_lengths(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("lang", F.char_length("text").alias("chars"))
    p = F.col("p")
    return exact_percentiles(sizes, "chars", [0.1, 0.5, 0.9], ["lang"]).select(
        "lang", "n", F.round(p[0], 6).alias("p10"), F.round(p[1], 6).alias("p50"), F.round(p[2], 6).alias("p90"))

