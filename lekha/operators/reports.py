"""Aggregate reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import once, words
from ..functions.spelling import count_sites, rule_sites
from ..functions.text import count_of, repetition_rate
from .ranking import exact_percentiles, with_rank
from .scoring import gram_sums


def letter_counts(df: DataFrame, text: str, letters: Sequence[str], source: str) -> DataFrame:
    """Per source and letter: total count and lines containing it."""
    sums = df.groupBy(source).agg(
        *[F.sum(count_of(text, c)).alias(f"n{i}") for i, c in enumerate(letters)],
        *[F.count_if(F.col(text).contains(c)).alias(f"l{i}") for i, c in enumerate(letters)],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("letter"), F.col(f"n{i}").alias("total"), F.col(f"l{i}").alias("lines"))
                     for i, c in enumerate(letters)])
    return sums.select(source, F.explode(rows).alias("x")).select(source, "x.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def map_totals(df: DataFrame, column: str) -> DataFrame:
    """Sum of a {name: count} map over all rows."""
    return df.select(F.explode(column).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))


def success_rates(photos: DataFrame, pages: DataFrame, ok: Column) -> DataFrame:
    """Successes over photos and over distinct pages."""
    def one(df: DataFrame, unit: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.avg(ok.cast("double")).alias("rate")
                      ).select(F.lit(unit).alias("unit"), "n", "n_ok", "rate")

    return one(photos, "photo").unionByName(one(pages, "page"))


def ratio_distribution(df: DataFrame, ratio: str) -> DataFrame:
    """count, median, p90 and max."""
    return exact_percentiles(df, ratio, [0.5, 0.9, 1.0]).select(
        "n", F.col("p")[0].alias("median"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("max"))


def split_by_band(df: DataFrame, is_test: str, in_band: str) -> DataFrame:
    """Rows and in-band rows per split, with the total as a NULL split."""
    return df.cube(is_test).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(in_band)).alias("n_in_band"))


def domain_gap(stats: DataFrame, side: str, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """value(a) - value(b) for each statistic; one row per side comes in."""
    def of(tag: str, c: str) -> Column:
        return F.max(F.when(F.col(side) == tag, F.col(c)))

    return stats.agg(*[(of(a, c) - of(b, c)).alias(f"gap_{c}") for c in columns])


def gap_decomposition(stats: DataFrame, side: str, value: str, outer: str, middle: str, inner: str) -> DataFrame:
    """Split outer - inner into its part up to ``middle`` and the rest."""
    def of(tag: str) -> Column:
        return F.max(F.when(F.col(side) == tag, F.col(value)))

    parts = stats.agg((of(middle) - of(inner)).alias("texture"), (of(outer) - of(middle)).alias("shape"))
    total = F.col("texture") + F.col("shape")
    return parts.select("texture", "shape", total.alias("total"),
                        F.when(total != 0, F.col("texture") / total).alias("texture_share"),
                        F.when(total != 0, F.col("shape") / total).alias("shape_share"))


def scaling_fit(df: DataFrame, n: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """score = intercept + slope x log2(n), by least squares."""
    x = F.log2(F.col(n))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("points"), F.regr_slope(F.col(score), x).alias("slope"),
        F.regr_intercept(F.col(score), x).alias("intercept"))


def extrapolate(fit: DataFrame, sizes: Sequence[int]) -> DataFrame:
    size = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("n")
    return fit.select("*", size).withColumn("score", F.col("intercept") + F.col("slope") * F.log2("n"))


def overlap_report(df: DataFrame, source: str, target: str, stem: int = 4) -> DataFrame:
    """Micro-averaged share of target words, word stems and character n-grams
    that also occur in the row's source."""
    def stems(text: str) -> Column:
        long = F.filter(words(text), lambda w: F.char_length(w) >= stem)
        return F.transform(long, lambda w: F.substring(w, 1, stem))

    sums = gram_sums(df, [], {
        "word": (words(source), words(target), [1]), "stem": (stems(source), stems(target), [1]),
        "gram": (F.col(source), F.col(target), [stem])})
    rows = sums.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.get(kind, F.lit(0))["n_hyp"].alias("n_target"), F.get(kind, F.lit(0))["n_shared"].alias("n_shared"))
        for kind in ("word", "stem", "gram")])))
    return rows.where("n_target > 0").withColumn("share", F.col("n_shared") / F.col("n_target"))


def repetition_report(df: DataFrame, text: str, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(repetition_rate(words(text))).alias("mean_repetition"))


def rule_firings(df: DataFrame, text: str) -> DataFrame:
    """Per respelling rule: sites where it can fire and lines having one."""
    return _firing_report(df, text, list(rule_sites()), count_sites(text))


def pattern_report(df: DataFrame, text: str, rules: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """Per named pattern: matches, lines with a match, share of characters and lines."""
    return _firing_report(df, text, list(rules), F.array(*[F.regexp_count(text, F.lit(r)) for r in rules.values()]), group)


def _firing_report(df: DataFrame, text: str, names: list[str], counts: Column, group: Sequence[str] = ()) -> DataFrame:
    """The report on each line's ``counts``, one per name."""
    sums = once(df, group, chars=F.char_length(text), counts=counts).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"),
        *[F.sum(F.get("counts", F.lit(i))).alias(f"f{i}") for i in range(len(names))],
        *[F.count_if(F.get("counts", F.lit(i)) > 0).alias(f"l{i}") for i in range(len(names))],
    )
    rows = F.array(*[F.struct(
        F.lit(r).alias("rule"), F.col(f"f{i}").alias("firings"), F.col(f"l{i}").alias("lines"),
        (F.col(f"f{i}") / F.col("chars")).alias("char_share"), (F.col(f"l{i}") / F.col("n")).alias("line_share"),
    ) for i, r in enumerate(names)])
    return sums.select(*group, F.explode(rows).alias("x")).select(*group, "x.*")


def vocabulary_share(df: DataFrame, text: str, vocab: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of words found in ``vocab(word)``. Words are counted before the
    join, so a frequent word is looked up once."""
    counted = df.select(*group, F.explode(words(text)).alias("word")).groupBy(*group, "word").agg(
        F.count(F.lit(1)).alias("n"))
    known = vocab.select("word").distinct().withColumn("known", F.lit(1))
    hit = F.when(F.col("known") == 1, F.col("n")).otherwise(0)
    return counted.join(known, "word", "left").groupBy(*group).agg(
        F.sum("n").alias("n_words"), F.sum(hit).alias("n_known")).withColumn("share", F.col("n_known") / F.col("n_words"))


def review_accuracy(df: DataFrame, mark: str = "correct") -> DataFrame:
    """Share of reviewed rows marked 'y'; blank marks are not reviewed."""
    done = df.where(F.coalesce(F.col(mark), F.lit("")) != "")
    return done.agg(F.count(F.lit(1)).alias("n_reviewed"),
                    F.avg((F.lower(mark) == "y").cast("double")).alias("accuracy"))


def best_epochs(history: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """Epoch with the least score per run; NaN and NULL never win."""
    real = F.col(score).isNotNull() & ~F.isnan(score)
    return history.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.min_by(F.when(real, F.col(epoch)), F.when(real, F.struct(score, epoch))).alias("best_epoch"),
        F.min(F.when(real, F.col(score))).alias("best_score"))


def run_deltas(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """b - a per statistic for rows with the same key."""
    left = a.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    return left.join(b, list(key)).select(*key, *[(F.col(c) - F.col(f"__{c}")).alias(f"delta_{c}") for c in columns])


def demo_summary(lines: DataFrame) -> DataFrame:
    """Over lines: mean fraction uncertain, lines with doubt, branches that differ."""
    return lines.agg(
        F.count(F.lit(1)).alias("n_lines"), F.avg("fraction_uncertain").alias("mean_fraction_uncertain"),
        F.count_if(F.col("n_uncertain") > 0).alias("n_lines_with_uncertain"),
        F.count_if(F.coalesce("branches_differ", F.lit(False))).alias("n_branches_differ"))


def readable_recoveries(lines: DataFrame, least: int = 1, max_substitutions: int = 6, max_cer: float = 0.15,
                        max_chars: int = 220) -> DataFrame:
    """Lines worth showing: a recovery, few errors, short enough; best first."""
    keep = (F.col("recoveries") >= least) & (F.col("substitutions") <= max_substitutions) & (
        F.col("cer") <= max_cer) & (F.col("n_chars") <= max_chars)
    return lines.where(keep).orderBy("cer", F.desc("recoveries"))


def largest(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(n)


def reading_order(lines: DataFrame, page: str, y: str, key: str, band: float = 256.0) -> DataFrame:
    """Zero-based order of a page's lines by vertical position."""
    ranked = with_rank(lines, [page], [y, key], F.floor(F.col(y) / band), "__r")
    return ranked.withColumn("line_index", (F.col("__r") - 1).cast("int")).drop("__r")
