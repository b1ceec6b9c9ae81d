"""Consensus over repeated readings: ``readings(crop, sample_idx, text)``.

Equal readings of a crop are merged first and carry a weight, so any number
of copies costs one comparison. Distances exist only between different
readings of one crop. The mean over all pairs needs each of them, dealt in
blocks; the medoid is found from few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import strip
from ..functions.metrics import agreement_cer, edit_distance
from ..session import stored
from .joins import block_pairs, in_blocks
from .scoring import aligned_pairs


def distinct_readings(readings: DataFrame, key: str = "crop", drop_blank: bool = True) -> DataFrame:
    """(key, text, weight, first_idx) per different reading."""
    kept = readings.where(strip("text") != "") if drop_blank else readings
    return kept.groupBy(key, "text").agg(
        F.count(F.lit(1)).alias("weight"), F.min("sample_idx").alias("first_idx")
    )


def reading_distances(distinct: DataFrame, key: str = "crop") -> DataFrame:
    """Disagreement of each unordered pair of different readings, met block by block."""
    pairs = block_pairs(distinct, key, "first_idx", ["text", "weight"])
    return pairs.select(key, F.col("first_idx_a").alias("ia"), F.col("first_idx_b").alias("ib"), F.col("weight_a").alias("wa"),
                        F.col("weight_b").alias("wb"), agreement_cer("text_a", "text_b").alias("d"))


_GRAM = 3
_SLACK = 1e-6  # sums of shares are compared no finer when a reading is ruled out


def _sum_bounds(distinct: DataFrame, met: DataFrame, key: str) -> DataFrame:
    """(key, first_idx, bound): no more than the reading's summed disagreement with all readings of its crop.

    ``met`` holds every reading's distance from one reading of its crop, the
    pivot. Readings far from it bound by the triangle rule: two readings are at
    least as far apart as their distances from the pivot differ. Readings near
    it bound by trigrams: an edit adds or takes at most 2 x 3 of them. Summed
    over a crop both need counts only: how many readings are how far, and how
    many have a trigram how often.
    """
    near = F.col("edits") * 2 * _GRAM <= F.col("len")
    sizes = met.groupBy(key).agg(F.max("len").alias("longest"), F.coalesce(F.sum(F.when(near, F.col("weight"))), F.lit(0)).alias("n"))
    far = met.where(~near).groupBy(key, F.col("edits").alias("e")).agg(F.sum("weight").alias("w"), F.max("len").alias("l"))
    far = far.groupBy(key).agg(F.collect_list(F.struct("e", "w", "l")).alias("far"))
    apart = F.coalesce(F.aggregate("far", F.lit(0.0), lambda acc, c: acc + F.abs(F.col("edits") - c.e) * c.w / F.greatest("len", c.l, F.lit(1))), F.lit(0.0))

    places = F.sequence(F.lit(1), F.greatest(F.col("len") - _GRAM + 1, F.lit(1)))
    texts = distinct.select(key, "first_idx", "text").join(met.select(key, "first_idx", "len", F.when(near, F.col("weight")).otherwise(0).alias("x")),
                                                           [key, "first_idx"])
    grams = texts.select(key, "first_idx", "x", F.explode(places).alias("at"), "text").select(
        key, "first_idx", "x", F.substring("text", F.col("at"), F.lit(_GRAM)).alias("gram"))
    held = grams.groupBy(key, "first_idx", "x", "gram").agg(F.count(F.lit(1)).alias("c"))
    per_gram = held.groupBy(key, "gram", "c").agg(F.sum("x").alias("w")).groupBy(key, "gram").agg(
        F.collect_list(F.struct("c", "w")).alias("counts"), F.sum("w").alias("have"), F.sum(F.col("c") * F.col("w")).alias("none"))
    whole = per_gram.groupBy(key).agg(F.sum("none").alias("all"))
    # What a reading's own trigrams change against a text that has none of them.
    differ = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + F.abs(F.col("c") - x.c) * x.w) + F.col("c") * (
        F.col("n") - F.col("have")) - F.col("none")
    own = held.join(per_gram, [key, "gram"]).join(sizes, key).groupBy(key, "first_idx").agg(F.sum(differ).alias("own"))
    bound = apart + (F.col("own") + F.col("all")) / (2 * _GRAM * F.greatest("longest", F.lit(1)))
    return own.join(met.select(key, "first_idx", "len", "edits"), [key, "first_idx"]).join(sizes, key).join(whole, key).join(far, key, "left").select(
        key, "first_idx", bound.alias("bound"))


_FEW = 8  # different readings of a crop that are compared pair by pair: bounds would cost more than those distances


def medoids(readings: DataFrame, key: str = "crop") -> DataFrame:
    """The reading with the least summed disagreement, the earliest on ties;
    the empty text when every reading is blank."""
    distinct = distinct_readings(readings, key)
    crowded = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("different")).where(F.col("different") > _FEW).select(key)
    few = distinct.join(crowded, key, "left_anti")
    ends = reading_distances(few, key).select(key, F.explode(F.array(
        F.struct(F.col("ia").alias("idx"), (F.col("wb") * F.col("d")).alias("d")),
        F.struct(F.col("ib").alias("idx"), (F.col("wa") * F.col("d")).alias("d")),
    )).alias("e"))
    # Rounded, so that the order of summation cannot break a tie.
    sums = ends.groupBy(key, F.col("e.idx").alias("first_idx")).agg(F.round(F.sum("e.d"), 9).alias("total"))
    ranked = few.join(sums, [key, "first_idx"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    best = ranked.groupBy(key).agg(
        F.min_by("text", F.struct("total", "first_idx")).alias("base"), F.sum("weight").alias("n"))
    if not crowded.isEmpty():
        found, _ = medoid_search(readings.join(crowded, key, "left_semi"), key)
        best = best.unionAll(found.select(best.columns))
    return readings.select(key).distinct().join(best, key, "left").select(
        key, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("n", F.lit(0)).alias("n"))


def medoid_search(readings: DataFrame, key: str = "crop") -> tuple[DataFrame, int]:
    """`medoids` of crops with many different readings, and how many distances it took.

    Exact without all pairs: the reading with most copies is compared with all
    others of its crop first, which bounds every sum from below (`_sum_bounds`).
    Readings whose bound exceeds the best sum so far are out; of the rest, 1, 2,
    4, ... with the least bounds are compared next. A crop's readings are dealt
    to blocks, so a crop with very many readings is spread.
    """
    distinct = in_blocks(distinct_readings(readings.where(F.col(key).isNotNull()), key), key, "first_idx")
    distinct = stored(distinct.withColumn("len", F.char_length("text")), "readings")
    state = distinct.select(key, "first_idx", "weight", F.lit(0.0).alias("bound"), F.lit(None).cast("double").alias("total"))
    order = W.partitionBy(key).orderBy("bound", F.desc("weight"), "first_idx")
    took, together = 0, 1
    while True:
        best = state.groupBy(key).agg(F.coalesce(F.min("total"), F.lit(float("inf"))).alias("least"))
        live = state.join(best, key).where(F.col("total").isNull() & (F.col("bound") - _SLACK <= F.col("least")))
        chosen = live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= together).select(key, "first_idx")
        asked = chosen.join(distinct, [key, "first_idx"]).select(
            key, F.col("first_idx").alias("from"), F.col("text").alias("from_text"), F.col("len").alias("from_len"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        met = stored(asked.join(distinct, [key, "block"]).select(
            key, "from", "first_idx", "weight", "len", edit_distance("from_text", "text").alias("edits"),
            F.greatest("from_len", "len").alias("longest")), "distances")
        new = met.count()
        if not new:
            break
        # Rounded, so that the order of summation cannot break a tie.
        share = F.when(F.col("longest") > 0, F.col("edits") / F.col("longest")).otherwise(0.0)
        sums = met.groupBy(key, F.col("from").alias("first_idx")).agg(F.round(F.sum(F.col("weight") * share), 9).alias("sum"))
        known = state.drop("bound").join(_sum_bounds(distinct, met, key), [key, "first_idx"]) if not took else state
        state = stored(known.join(sums, [key, "first_idx"], "left").select(
            key, "first_idx", "weight", "bound", F.coalesce("total", "sum").alias("total")), "sums")
        took, together = took + new, 2 * together
    found = state.join(distinct.select(key, "first_idx", "text"), [key, "first_idx"]).groupBy(key).agg(
        F.min_by("text", F.when(F.col("total").isNotNull(), F.struct("total", "first_idx"))).alias("base"), F.sum("weight").alias("n"))
    return readings.select(key).distinct().join(found, key, "left").select(
        key, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("n", F.lit(0)).alias("n")), took


def position_votes(readings: DataFrame, bases: DataFrame, key: str = "crop") -> DataFrame:
    """(key, pos, char, votes, n): what the readings put at each base position.

    A reading that lacks the position votes ''. Extra characters of a reading
    belong to no position.
    """
    distinct = distinct_readings(readings, key).select(key, "text", "weight")
    pairs = distinct.join(bases.where("base <> ''").select(key, "base", "n"), key)
    votes = aligned_pairs(pairs, [key, "n", "weight"], "base", "text").where("ref_idx is not null")
    return votes.groupBy(key, F.col("ref_idx").alias("pos"), "n", F.coalesce("hyp_ch", F.lit("")).alias("char")).agg(
        F.sum("weight").alias("votes"), F.max("ref_ch").alias("chosen")
    )


def consensus_slots(votes: DataFrame, key: str = "crop") -> DataFrame:
    """One row per base position: agreement and the alternatives by share,
    equal shares by character."""
    share = F.col("votes") / F.col("n")
    ordered = F.sort_array(F.collect_list(F.struct((-share).alias("s"), F.col("char").alias("c"))))
    return votes.groupBy(key, "pos", "n", "chosen").agg(
        F.max(F.when(F.col("char") == F.col("chosen"), share)).alias("agreement"),
        F.transform(ordered, lambda a: F.struct(a["c"].alias("char"), (-a["s"]).alias("prob"))).alias("alternatives"),
    )


def uncertain_slots(slots: DataFrame, agree_below: float = 1.0) -> DataFrame:
    """Every contested position; a display may cap it, an analysis must not."""
    return slots.where(F.coalesce("agreement", F.lit(0.0)) < agree_below)


def variant_lines(bases: DataFrame, uncertain: DataFrame, max_variants: int = 5, key: str = "crop") -> DataFrame:
    """The base (rank 0), then one-character swaps, most probable first."""
    swaps = (
        uncertain.select(key, "pos", "chosen", F.explode("alternatives").alias("a"))
        .where("a.char <> chosen")
        .select(key, "pos", F.col("a.char").alias("char"), F.round("a.prob", 3).alias("prob"))
    )
    best = W.partitionBy(key).orderBy(F.desc("prob"), F.desc("pos"), F.desc("char"))
    ranked = swaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_variants - 1)
    live = bases.where("base <> ''").select(key, "base")
    swapped = ranked.join(live, key).select(
        key, "rank", F.overlay("base", "char", F.col("pos") + 1, F.lit(1)).alias("text"), "prob"
    )
    return live.select(key, F.lit(0).alias("rank"), F.col("base").alias("text"), F.lit(1.0).alias("prob")).unionByName(
        swapped)


def sample_disagreement(readings: DataFrame, key: str = "crop") -> DataFrame:
    """Mean disagreement over all pairs of readings, blank ones included; 0 for one."""
    distinct = distinct_readings(readings, key, drop_blank=False)
    sums = reading_distances(distinct, key).groupBy(key).agg(
        F.sum(F.col("wa") * F.col("wb") * F.col("d")).alias("total")
    )
    sizes = readings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n_pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / n_pairs).otherwise(F.lit(0.0))
    return sizes.join(sums, key, "left").select(key, mean.alias("mean_disagreement"))


def consensus_summary(bases: DataFrame, slots: DataFrame, uncertain: DataFrame, key: str = "crop") -> DataFrame:
    """Per crop: characters, contested characters, their share, mean agreement."""
    sizes = slots.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_chars"), F.avg(F.coalesce("agreement", F.lit(0.0))).alias("mean_top1"))
    unsure = uncertain.groupBy(key).agg(F.count(F.lit(1)).alias("n_uncertain"))
    out = bases.select(key).join(sizes, key).join(unsure, key, "left").na.fill(0, ["n_uncertain"])
    return out.withColumn("fraction_uncertain", F.col("n_uncertain") / F.col("n_chars"))


def branches_differ(df: DataFrame, a: str, b: str) -> DataFrame:
    """NULL where either branch is missing."""
    return df.withColumn("branches_differ", F.col(a) != F.col(b))
