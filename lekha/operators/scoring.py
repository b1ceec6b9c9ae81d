"""Scores over tables of reference/hypothesis pairs.

Every function takes keyed rows. A key missing on one side is an error, never
a silent shift: see `paired`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alignment import align_pairs
from ..functions.expr import WS_RUN, col, words
from ..functions.metrics import agreement_cer
from ..functions.ngrams import STATS, gram_counts, row_ranges, text_sides, token_sides
from .ranking import exact_percentiles

# chrF++ orders and weight, BLEU orders.
CHAR_ORDERS = range(1, 7)
WORD_ORDERS = range(1, 3)
BETA = 2.0
BLEU_ORDERS = range(1, 5)
_LETTERS = 1 << 22  # characters of a batch that are held apart at once
ASCII_PUNCTUATION = r"""[!-/:-@\[-`{-~]"""


def paired(refs: DataFrame, hyps: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join references to hypotheses; a row without its partner fails the job."""
    joined = refs.withColumn("__r", F.lit(1)).join(hyps.withColumn("__h", F.lit(1)), list(key), "full")
    whole = F.col("__r").isNotNull() & F.col("__h").isNotNull()
    checked = F.when(whole, F.lit(True)).otherwise(
        F.raise_error(F.lit("reference and hypothesis rows do not match")).cast("boolean")
    )
    return joined.where(checked).drop("__r", "__h")


# ---- n-gram scores --------------------------------------------------------


def _split_word_marks(text: Column) -> Column:
    """Words with a trailing, else a leading, ASCII punctuation mark split off."""
    return F.flatten(F.transform(
        words(text),
        lambda w: F.when(F.char_length(w) == 1, F.array(w))
        .when(w.rlike(ASCII_PUNCTUATION + "$"),
              F.array(F.regexp_replace(w, "(?s).$", ""), F.regexp_extract(w, "(?s).$", 0)))
        .when(w.rlike("^" + ASCII_PUNCTUATION), F.array(F.substring(w, 1, 1), F.substring(w, 2, 2**30)))
        .otherwise(F.array(w)),
    ))


def gram_sums(df: DataFrame, group: Sequence[str], kinds: dict[str, tuple[Column, Column, Sequence[int]]],
              also: dict[str, Callable[[Column], Column]] | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """Per group and kind an array, one entry per order: sums over rows of the n-gram counts of both sides and their matches.

    A kind is (reference, hypothesis, orders), both texts (n-grams of
    characters) or arrays of tokens. All kinds cross into Python once, a batch
    at a time, and only sums reach the shuffle: exploding n-grams would multiply
    the data by the number of orders. A pair with a null side counts nothing.
    ``keep`` names further columns, ``also`` how to aggregate them.
    """
    group, keep, also = list(group), keep or {}, also or {}
    sides = {f"__{side}{i}": c for i, (ref, hyp, _) in enumerate(kinds.values()) for side, c in (("r", ref), ("h", hyp))}
    read = df.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *[c.alias(n) for n, c in keep.items()],
                     *[c.alias(n) for n, c in sides.items()])
    held = [f.name for f in read.schema.fields if f.name not in sides]
    orders = [sorted(o) for _, _, o in kinds.values()]
    is_text = [isinstance(read.schema[f"__r{i}"].dataType, T.StringType) for i in range(len(kinds))]
    width = len(STATS)
    schema = T.StructType([*[read.schema[n] for n in held], T.StructField("__counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i, wanted in enumerate(orders):
                pair = [batch.column(len(held) + 2 * i + k) for k in (0, 1)]
                whole = np.logical_and(*[c.is_valid().to_numpy(zero_copy_only=False) for c in pair])
                found = gram_counts(*(text_sides(*pair) if is_text[i] else token_sides(*pair)), wanted)
                parts.append((found * whole[:, None, None]).reshape(batch.num_rows, -1))
            counts = np.concatenate(parts, axis=1)
            edges = np.arange(batch.num_rows + 1, dtype=np.int32) * counts.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(counts.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(held))], lists], names=[f.name for f in schema.fields])

    rows = read.mapInArrow(run, schema)
    sums, at = [], 0
    for name, wanted in zip(kinds, orders):
        entries = []
        for n in wanted:
            entries.append(F.struct(F.lit(n).alias("order"), *[
                F.coalesce(F.sum(F.get("__counts", F.lit(at + k))), F.lit(0)).alias(stat) for k, stat in enumerate(STATS)]))
            at += width
        sums.append(F.array(*entries).alias(name))
    out = rows.groupBy(*[f"__g{i}" for i in range(len(group))]).agg(*sums, *[of(F.col(n)).alias(n) for n, of in also.items()])
    return out.select(*[F.col(f"__g{i}").alias(g) for i, g in enumerate(group)], *kinds, *also)


def _chrf_kinds(ref: str, hyp: str) -> dict[str, tuple[Column, Column, Sequence[int]]]:
    packed = [F.regexp_replace(c, WS_RUN, "") for c in (ref, hyp)]
    tokens = [_split_word_marks(F.col(c)) for c in (ref, hyp)]
    return {"chars": (*packed, CHAR_ORDERS), "words": (*tokens, WORD_ORDERS)}


def _bleu_kinds(ref: str, hyp: str) -> dict[str, tuple[Column, Column, Sequence[int]]]:
    return {"tokens": (tokenize_13a(ref), tokenize_13a(hyp), BLEU_ORDERS)}


def _chrf_score() -> Column:
    """From the sums of `_chrf_kinds`. A row's hypothesis n-grams count only where its reference has any."""
    live = F.filter(F.concat("chars", "words"), lambda s: (s.n_counted > 0) & (s.n_ref > 0))

    def mean(of: str) -> Column:
        total = F.aggregate(live, F.lit(0.0), lambda acc, s: acc + s.n_match / s[of])
        return F.when(F.size(live) > 0, total / F.size(live)).otherwise(F.lit(0.0))

    p, r, b2 = mean("n_counted"), mean("n_ref"), BETA * BETA
    return F.when(p + r > 0, 100 * (1 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))


def _bleu_score() -> Column:
    """From the sums of `_bleu_kinds`: exponential smoothing, 0 if an order has no n-gram."""
    log_sum, misses = F.lit(0.0), F.lit(0)
    usable, any_match = F.lit(True), F.lit(False)
    for i in range(len(BLEU_ORDERS)):
        entry = F.get("tokens", F.lit(i))
        total, match = entry["n_hyp"], entry["n_match"]
        misses = misses + F.when(match == 0, 1).otherwise(0)
        smoothed = F.when(match > 0, match / total).otherwise(1 / (F.pow(F.lit(2.0), misses) * total))
        log_sum = log_sum + F.log(smoothed)
        usable, any_match = usable & (total > 0), any_match | (match > 0)
    first = F.get("tokens", F.lit(0))
    brevity = F.when(first["n_hyp"] < first["n_ref"], F.exp(1 - first["n_ref"] / first["n_hyp"])).otherwise(F.lit(1.0))
    score = F.when(usable & any_match, 100 * brevity * F.exp(log_sum / len(BLEU_ORDERS)))
    return F.coalesce(score, F.lit(0.0))


def chrf_plus_plus(df: DataFrame, ref: str, hyp: str, group: Sequence[str] = ()) -> DataFrame:
    """Corpus chrF++ per group (one row without a group)."""
    return gram_sums(df, group, _chrf_kinds(ref, hyp)).select(*group, _chrf_score().alias("chrf"))


def tokenize_13a(text: Column | str) -> Column:
    """The mteval-v13a tokens of a line."""
    t = F.replace(F.replace(col(text), F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for entity, mark in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return words(t)


def bleu(df: DataFrame, ref: str, hyp: str, group: Sequence[str] = ()) -> DataFrame:
    """Corpus BLEU per group (one row without a group)."""
    return gram_sums(df, group, _bleu_kinds(ref, hyp)).select(*group, _bleu_score().alias("bleu"))


def compare_systems(df: DataFrame, ref: str, hyp: str, system: str, baseline: str) -> DataFrame:
    """Per system, a null one included: chrF++, BLEU, mean lengths and the chrF++ gain over a baseline, from one pass."""
    sums = gram_sums(
        df, [system], {**_chrf_kinds(ref, hyp), **_bleu_kinds(ref, hyp)},
        keep={"mean_hyp_chars": F.char_length(hyp), "mean_ref_chars": F.char_length(ref), "n": F.lit(1)},
        also={"n": F.sum, "mean_hyp_chars": F.avg, "mean_ref_chars": F.avg})
    scores = sums.select(system, "n", "mean_hyp_chars", "mean_ref_chars", _chrf_score().alias("chrf"), _bleu_score().alias("bleu"))
    # One row per system, so a window over all of them is small.
    base = F.max(F.when(F.col(system) == baseline, F.col("chrf"))).over(W.partitionBy(F.lit(0)))
    return scores.withColumn("chrf_gain", F.col("chrf") - base)


# ---- alignment ------------------------------------------------------------


def aligned_pairs(df: DataFrame, keep: Sequence[str], ref: str, hyp: str) -> DataFrame:
    """One row per aligned position: kept columns, indices and characters.

    ``ref_idx`` or ``hyp_idx`` is NULL for an insertion or a deletion; a pair
    with a null side gives no row. Pairs are aligned many at a time inside
    Arrow batches; nothing is shuffled.
    """
    keep = list(keep)
    kept = [df.schema[name] for name in keep]
    schema = T.StructType([
        *kept,
        T.StructField("ref_idx", T.IntegerType()), T.StructField("hyp_idx", T.IntegerType()),
        T.StructField("ref_ch", T.StringType()), T.StructField("hyp_ch", T.StringType()),
    ])
    n_keys = len(keep)

    def side(letters: pa.Array, starts: np.ndarray, pair: np.ndarray, idx: np.ndarray) -> tuple[pa.Array, pa.Array]:
        none = idx < 0
        return pa.array(idx, pa.int32(), mask=none), letters.take(pa.array(starts[pair] + idx, pa.int64(), mask=none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.compute.and_(*[batch.column(n_keys + i).is_valid() for i in (0, 1)])
            batch = batch.filter(whole)
            lengths = [np.concatenate([[0], np.cumsum(pa.compute.utf8_length(batch.column(n_keys + i)).to_numpy(), dtype=np.int64)]) for i in (0, 1)]
            for first, stop in row_ranges(lengths, _LETTERS):
                part = batch.slice(first, stop - first)
                texts = [part.column(n_keys + i) for i in (0, 1)]
                letters = [pa.array(list("".join(t.to_pylist())), pa.string()) for t in texts]
                sides = text_sides(*texts)
                for pair, *indices in align_pairs(*sides):
                    at = pa.array(pair)
                    (r_idx, r_ch), (h_idx, h_ch) = (side(c, s[1], pair, idx) for c, s, idx in zip(letters, sides, indices))
                    columns = [part.column(i).take(at) for i in range(n_keys)]
                    yield pa.RecordBatch.from_arrays([*columns, r_idx, h_idx, r_ch, h_ch], names=[f.name for f in schema.fields])

    return df.select(*keep, F.col(ref).alias("__r"), F.col(hyp).alias("__h")).mapInArrow(run, schema)


def confusion_counts(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """How often each reference character was read as each hypothesis character."""
    return pairs.groupBy(*group, "ref_ch", "hyp_ch").agg(F.count(F.lit(1)).alias("n"))


def replace_where_agreed(df: DataFrame, key: Sequence[str], ref: str, hyp: str, old: str, new: str) -> DataFrame:
    """Reference with ``old`` set to ``new`` wherever the aligned hypothesis has ``new``."""
    pairs = aligned_pairs(df, key, ref, hyp).where(F.col("ref_idx").isNotNull())
    swap = (F.col("ref_ch") == old) & F.coalesce(F.col("hyp_ch") == new, F.lit(False))
    fixed = F.when(swap, F.lit(new)).otherwise(F.col("ref_ch"))
    rebuilt = pairs.groupBy(*key).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("ref_idx", fixed.alias("c"))))["c"], "").alias("fixed"),
        F.count_if(swap).alias("n_swapped"),
    )
    return df.join(rebuilt, list(key), "left").select(
        df["*"], F.coalesce("fixed", F.col(ref)).alias("fixed"), F.coalesce("n_swapped", F.lit(0)).alias("n_swapped")
    )


def correction_variants(df: DataFrame, key: Sequence[str], ref: str, hyp: str, old: str, new: str) -> DataFrame:
    """Mean and median disagreement for as_typed, machine_agreed and blanket."""
    fixed = replace_where_agreed(df, key, ref, hyp, old, new)

    def blanket(c: str) -> Column:
        return F.replace(F.col(c), F.lit(old), F.lit(new))

    scored = fixed.select(F.explode(F.array(
        F.struct(F.lit("as_typed").alias("variant"), agreement_cer(ref, hyp).alias("cer")),
        F.struct(F.lit("machine_agreed").alias("variant"), agreement_cer("fixed", hyp).alias("cer")),
        F.struct(F.lit("blanket").alias("variant"), agreement_cer(blanket(ref), blanket(hyp)).alias("cer")),
    )).alias("s")).select("s.*")
    means = scored.groupBy("variant").agg(F.avg("cer").alias("mean_cer"))
    medians = exact_percentiles(scored, "cer", [0.5], ["variant"])
    return means.join(medians, "variant").select("variant", "mean_cer", F.col("p")[0].alias("median_cer"))


def sample_recovery(gold: DataFrame, consensus: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Per key: consensus substitutions, and how many some sample had right.

    ``gold(key, text)``, ``consensus(key, text)``, ``samples(key, sample_idx, text)``.
    """
    g = gold.select(key, F.col("text").alias("gold"))
    wrong = (
        aligned_pairs(g.join(consensus.select(key, F.col("text").alias("base")), key), [key], "gold", "base")
        .where("ref_idx is not null and hyp_idx is not null and ref_ch <> hyp_ch")
        .select(key, "ref_idx")
    )
    right = (
        aligned_pairs(g.join(samples.select(key, "text").distinct(), key), [key], "gold", "text")
        .where("ref_idx is not null and hyp_idx is not null and ref_ch = hyp_ch")
        .select(key, "ref_idx").distinct().withColumn("hit", F.lit(1))
    )
    per_line = wrong.join(right, [key, "ref_idx"], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("consensus_wrong"), F.count("hit").alias("some_sample_right")
    )
    return g.join(consensus.select(key), key).select(key).join(per_line, key, "left").select(
        key, F.coalesce("consensus_wrong", F.lit(0)).alias("consensus_wrong"),
        F.coalesce("some_sample_right", F.lit(0)).alias("some_sample_right"),
    )


def slot_recovery(truth: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """Per line: substitutions against the truth and those a flagged slot still held.

    ``truth(key, packed)`` holds packed symbols; ``slots(key, slot, chosen,
    uncertain, alternatives)`` one packed symbol per slot and an array of
    rival symbols.
    """
    read = slots.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("slot", "chosen")))["chosen"], "").alias("read")
    )
    both = truth.join(read, key, "left").withColumn("read", F.coalesce("read", F.lit("")))
    subs = (
        aligned_pairs(both, [key], "packed", "read")
        .where("ref_idx is not null and hyp_idx is not null and ref_ch <> hyp_ch")
        .select(key, F.col("hyp_idx").alias("slot"), "ref_ch")
    )
    held = subs.join(slots.select(key, "slot", "uncertain", "alternatives"), [key, "slot"])
    hit = F.col("uncertain") & F.array_contains("alternatives", F.col("ref_ch"))
    per_line = held.groupBy(key).agg(
        F.count(F.lit(1)).alias("substitutions"), F.count_if(hit).alias("recoveries")
    )
    return truth.select(key).join(per_line, key, "left").na.fill(0, ["substitutions", "recoveries"])


def position_accuracy(df: DataFrame, predicted: str, target: str, pad: int) -> DataFrame:
    """Share of non-padding positions predicted right, over all positions; not a mean of batch means."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"))).alias("x"))
    real = pairs.where(F.col("x.t") != pad)
    return real.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col("x.p") == F.col("x.t"), F.lit(False)).cast("double")).alias("accuracy"),
    )


def score_summary(df: DataFrame, score: str, within: float = 0.35, group: Sequence[str] = ()) -> DataFrame:
    """count, mean, median, min, max and the number within a limit."""
    group = list(group)
    plain = df.groupBy(*group).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("min"),
        F.max(score).alias("max"), F.count_if(F.col(score) <= within).alias("n_within"),
    )
    mid = exact_percentiles(df, score, [0.5], group)
    if group:
        # A group without scores has no median.
        named = mid.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("p")[0].alias("median"))
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
        return plain.join(named, same, "left").drop(*[f"__{g}" for g in group])
    return plain.withColumn("median", mid.select(F.col("p")[0]).scalar())


def flagged_summary(df: DataFrame, flag: str, score: str) -> DataFrame:
    """Count and mean score of flagged and unflagged rows; an empty side is NULL."""
    on, off = F.col(flag), ~F.col(flag)
    return df.agg(
        F.count_if(on).alias("n_flagged"), F.count_if(off).alias("n_unflagged"),
        F.avg(F.when(on, F.col(score))).alias("mean_flagged"),
        F.avg(F.when(off, F.col(score))).alias("mean_unflagged"),
    )


def paired_comparison(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two scores per row: means, medians, difference and rows where b is lower."""
    plain = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.count_if(F.col(b) < F.col(a)).alias("n_b_better"),
    )
    mid_a = exact_percentiles(df, a, [0.5]).select(F.col("p")[0])
    mid_b = exact_percentiles(df, b, [0.5]).select(F.col("p")[0])
    return plain.withColumn("difference", F.col("mean_b") - F.col("mean_a")).withColumn(
        "median_a", mid_a.scalar()).withColumn("median_b", mid_b.scalar())


