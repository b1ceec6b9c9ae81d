"""Quality rules: a learned decision list over text statistics.

Statistics are array functions over a text's words; nothing is exploded or
shuffled. The list is learned by sequential covering: a rule grows one
threshold condition at a time by information gain on two thirds of the
labelled rows, loses trailing conditions that do not pay on the other third,
and is accepted if its precision there is high enough; the rows it covers
leave. The result is an ordered chain of ``when`` expressions. The driver
sees one histogram row per statistic and bin in each step.

Only DataFrame functions are used. Cases: a null text has no words and every
statistic is 0; labels that are null, or contradict each other for one id,
teach nothing; without labels there are no rules and only the base filter
decides; repeated rows are judged one by one. Words found repeatedly are
compared by a 64-bit hash of three words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let, once
from ..session import stored
from .common import WORD

FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "capital_share": "n_capitals / word_chars",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "chars_per_word": "word_chars / n_words",
    "words": "n_words",
}
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _repeats(w: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i"))))
    windows = F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))

    def covered(s: Column) -> Column:
        twins = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        places = F.array_sort(F.transform(twins, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(
            p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))),
            F.lit(0), lambda total, n: total + n))

    return let(windows, lambda x: F.when(
        F.size(F.array_distinct(F.transform(x, lambda y: y["h"]))) == F.size(x), F.lit(0)).otherwise(
            let(F.array_sort(x), covered)))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts of every text beside the columns ``keep``."""
    text = F.coalesce("text", F.lit(""))
    counts = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), _repeats(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    line_counts = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    df = once(docs, list(keep), c=counts, l=line_counts,
              n_symbols=F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
              n_marks=F.regexp_count(text, F.lit(r"[!|?]")).cast("long"),
              n_capitals=F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"))
    df = df.select(*keep, "c.*", "l.*", "n_symbols", "n_marks", "n_capitals")
    return df.withColumn("base_failed", F.expr(BASE))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def expression(self) -> Column:
        value = F.coalesce(F.expr(FEATURES[self.feature]).cast("double"), F.lit(0.0))
        return value >= self.threshold if self.at_least else value < self.threshold


def rejected(rules: list[list[Condition]]) -> Column:
    """The decision list: the first rule that fits rejects; otherwise the row is kept."""
    out = None
    for rule in rules:
        fits = rule[0].expression()
        for c in rule[1:]:
            fits = fits & c.expression()
        out = F.when(fits, True) if out is None else out.when(fits, True)
    return F.lit(False) if out is None else out.otherwise(False)


def learn(stats: DataFrame, labels: DataFrame, rows: int = 50_000, bins: int = 24, rules: int = 10,
          conditions: int = 3, precision: float = 0.95) -> list[list[Condition]]:
    """Rules that reject ``quality = 0``, learned from at most about ``rows`` labelled rows.

    Rows that the base filter rejects teach nothing: the rules only decide the rest.
    """
    clean = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    clean = clean.where("lo = hi").select("doc_id", (F.col("lo") == 0).alias("bad"))
    known = stats.where("not base_failed").join(clean, "doc_id").withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)))
    values = [F.coalesce(F.expr(f).cast("double"), F.lit(0.0)).alias(n) for n, f in FEATURES.items()]
    known = stored(known.select("bad", "draw", *values), "labelled")
    n = known.count()
    if n == 0:
        return []
    sample = known.where(F.col("draw") < int(1_000_000 * min(1.0, rows / n)))
    steps = [(k + 1) / (bins + 1) for k in range(bins)]

    cuts_row = sample.agg(*[F.percentile_approx(F.when(F.col("bad") == b, F.col(f)), steps, 1000).alias(f"{f}_{b}")
                            for f in FEATURES for b in (True, False)]).first()
    cuts = {f: sorted({x for b in (True, False) for x in (cuts_row[f"{f}_{b}"] or [])}) for f in FEATURES}
    def bin_of(f: str) -> Column:
        at = F.array(*[F.lit(x) for x in cuts[f]]).cast("array<double>")
        return F.size(F.filter(at, lambda t: t <= F.col(f))).alias(f)

    data = stored(sample.select("bad", (F.col("draw") % 3 < 2).alias("grow"), *[bin_of(f) for f in FEATURES]), "binned")

    names = list(FEATURES)
    found: list[list[tuple[int, bool, int]]] = []

    def holds(rule) -> Column:
        out = F.lit(True)
        for f, at_least, k in rule:
            out = out & ((F.col(names[f]) >= k) if at_least else (F.col(names[f]) < k))
        return out

    bad, good = F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n")
    while len(found) < rules:
        left = data
        for rule in found:
            left = left.where(~holds(rule))
        rule: list[tuple[int, bool, int]] = []
        for _ in range(conditions):
            table = left.where("grow").where(holds(rule)).select(F.posexplode(F.array(*names)).alias("f", "bin"), "bad")
            best = _best(table.groupBy("f", "bin").agg(bad, good).collect(), rule)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        prefixes = [F.sum((holds(rule[:k]) & (F.col("bad") == b)).cast("int")).alias(f"{k}_{b}")
                    for k in range(1, len(rule) + 1) for b in (True, False)]
        score = left.where("not grow").agg(*prefixes).first()
        hits = {k: (score[f"{k}_True"] or 0, score[f"{k}_False"] or 0) for k in range(1, len(rule) + 1)}
        k = max(hits, key=lambda k: ((hits[k][0] - hits[k][1]) / max(1, sum(hits[k])), hits[k][0], -k))
        p, q = hits[k]
        if p < 2 or (p + 1) / (p + q + 2) < precision and q > 0:
            break
        found.append(rule[:k])
    return [[Condition(names[f], at_least, cuts[names[f]][k - 1]) for f, at_least, k in rule] for rule in found]


def _best(rows: list, rule: list) -> tuple[int, bool, int] | None:
    """The condition of largest gain in one histogram per statistic."""
    p0, n0 = sum(r["p"] for r in rows if r["f"] == 0), sum(r["n"] for r in rows if r["f"] == 0)
    if not p0 or not n0:
        return None
    base, best, gain = math.log2(p0 / (p0 + n0)), None, 0.01 * p0
    for f in sorted({r["f"] for r in rows}):
        own = sorted((r["bin"], r["p"], r["n"]) for r in rows if r["f"] == f)
        p, n = 0, 0
        for k, bp, bn in own:
            for at_least, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if k > 0 and a and (f, at_least, k) not in rule:
                    g = a * (math.log2(a / (a + b)) - base)
                    if g > gain:
                        best, gain = (f, at_least, k), g
            p, n = p + bp, n + bn
    return best


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics of every row with ``kept``: neither the base filter nor a learned rule rejects it."""
    stats = stored(statistics(docs), "quality")
    rules = learn(stats, labels, **options)
    return stats.withColumn("kept", ~F.col("base_failed") & ~rejected(rules))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    The statistics cost far more than moving a text: they are computed once, and rows whose id and text were rejected go.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    stats = stored(statistics(own, keep=("doc_id", "text_hash")), "quality")
    gone = stats.where(F.col("base_failed") | rejected(learn(stats, labels, **options))).select(
        F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_hash"))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti").select(*docs.columns)
