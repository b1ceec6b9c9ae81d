"""Building one label set from several labellers, counting every rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import encodable
from ..functions.expr import strip
from ..functions.metrics import agreement_cer, agreement_within
from ..functions.text import page_group
from ..session import stored
from .ranking import exact_percentiles

# The filters' limits.
MAX_DISAGREEMENT = 0.35
LENGTH_MADS = 3.5
MIN_CHARS = 8
LEAST_ROWS_FOR_BAND = 8
LEAST_MAD = 1e-6


def primary_labeller(labels: DataFrame) -> DataFrame:
    """The labeller with most rows; the first name wins ties. One row."""
    sizes = labels.groupBy("labeller").agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy(F.desc("n"), "labeller").limit(1)


def pending_crops(crops: DataFrame, labels: DataFrame) -> DataFrame:
    """Crops without a successful label; errored ones are tried again."""
    done = labels.where("text is not null").select("crop")
    return crops.join(done, "crop", "left_anti")


def screen_candidates(labels: DataFrame, crops: DataFrame, group: str | None = None,
                      min_chars: int = MIN_CHARS, digits: bool = False,
                      is_encodable: Column | None = None, primary: Column | None = None) -> DataFrame:
    """Primary rows with crop facts and the first reason for rejection.

    A crop the manifest does not know counts as a candidate only
    (reason ``unmatched``).
    """
    if primary is None:
        primary = primary_labeller(labels).select("labeller").scalar()
    rows = labels.where(F.col("labeller") == primary).join(crops.withColumn("__known", F.lit(True)), "crop", "left")
    text = strip("text")
    size = F.char_length(text)
    ok = encodable(text, digits) if is_encodable is None else is_encodable
    in_group = F.lit(True) if group is None else page_group("page") == group
    reason = (
        F.when(F.col("__known").isNull(), "unmatched")
        .when(~in_group, "group").when(size == 0, "empty").when(size < min_chars, "short")
        .when(~ok, "unencodable")
    )
    aspect = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(F.lit(0.0))
    return rows.select(
        "crop", "page", text.alias("text"), "width", "height", aspect.alias("aspect"), reason.alias("reason")
    )


def length_band(screened: DataFrame, mads: float = LENGTH_MADS) -> DataFrame:
    """One row: n, median, mad, low, high of characters per unit of aspect; none where no row has an aspect.

    Both medians come from one stored table of different densities and their
    counts. They are two numbers, so the second is asked with the first at hand.
    """
    dens = screened.where("reason is null and aspect <> 0").groupBy((F.char_length("text") / F.col("aspect")).alias("d"))
    dens = stored(dens.agg(F.count(F.lit(1)).alias("c")), "densities")
    schema = "n long, median double, mad double, low double, high double"
    middle = exact_percentiles(dens, "d", [0.5], weight="c").first()
    if middle is None:
        return dens.sparkSession.createDataFrame([], schema)
    n, (median,) = middle
    off = dens.select(F.abs(F.col("d") - median).alias("o"), "c")
    mad = exact_percentiles(off, "o", [0.5], weight="c").first()["p"][0] or LEAST_MAD
    return dens.sparkSession.createDataFrame([(n, median, mad, median - mads * mad, median + mads * mad)], schema)


def apply_length_band(screened: DataFrame, mads: float = LENGTH_MADS) -> DataFrame:
    """Reject rows outside the band; with fewer than eight rows nothing is."""
    band = length_band(screened, mads).first()
    density = F.when(F.col("aspect") != 0, F.char_length("text") / F.col("aspect")).otherwise(F.lit(0.0))
    outside = F.lit(False)
    if band is not None and band["n"] >= LEAST_ROWS_FOR_BAND:
        outside = ~F.col("density").between(band["low"], band["high"])
    return screened.withColumn("density", density).withColumn("reason", F.coalesce("reason", F.when(outside, "length")))


def closest_other(rows: DataFrame, others: DataFrame, limit: float | None = None) -> DataFrame:
    """Least disagreement of each crop with any other labeller's non-blank text.

    With a ``limit``, distances stop there, which is much cheaper for unlike
    texts: a disagreement beyond it is given as 1.
    """
    theirs = others.where(strip("text") != "").select("crop", F.col("text").alias("other"))
    apart = agreement_cer("text", "other") if limit is None else agreement_within("text", "other", limit)
    return rows.select("crop", "text").join(theirs, "crop").groupBy("crop").agg(F.min(apart).alias("disagreement"))


def apply_agreement(screened: DataFrame, labels: DataFrame, primary: str | None, limit: float = MAX_DISAGREEMENT,
                    exact: bool = True) -> DataFrame:
    """Reject rows no other labeller comes close to; unchecked rows stay."""
    others = labels.where(F.col("labeller") != F.lit(primary))
    scores = closest_other(screened.where("reason is null"), others, None if exact else limit)
    far = F.coalesce(F.col("disagreement") > limit, F.lit(False))
    return screened.join(scores, "crop", "left").withColumn(
        "reason", F.coalesce("reason", F.when(far, "disagreement")))


def build_label_set(labels: DataFrame, crops: DataFrame, group: str | None = None,
                    max_disagreement: float = MAX_DISAGREEMENT, mads: float = LENGTH_MADS,
                    min_chars: int = MIN_CHARS, digits: bool = False,
                    is_encodable: Column | None = None, exact: bool = True) -> DataFrame:
    """Every candidate with its reason; NULL marks the kept ones.

    The screened rows feed two medians, the band and the agreement check, so
    they are stored once instead of joined again for each. Without ``exact``,
    disagreements over the limit are only told apart from those within.
    """
    primary = primary_labeller(labels).first()
    primary = None if primary is None else primary["labeller"]
    screened = stored(screen_candidates(labels, crops, group, min_chars, digits, is_encodable, F.lit(primary)), "screened")
    return apply_agreement(apply_length_band(screened, mads), labels, primary, max_disagreement, exact)


def funnel(label_set: DataFrame) -> DataFrame:
    return label_set.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def cross_check_report(label_set: DataFrame) -> DataFrame:
    """Cross-checked rows, their mean disagreement, kept rows, characters, pages.

    Pages are counted; list them with `kept_pages`.
    """
    checked = F.col("disagreement").isNotNull()
    kept = F.col("reason").isNull()
    return label_set.agg(
        F.count_if(checked).alias("n_cross_checked"), F.avg("disagreement").alias("mean_disagreement"),
        F.count_if(kept).alias("n_kept"),
        F.coalesce(F.sum(F.when(kept, F.char_length("text"))), F.lit(0)).alias("total_chars"),
        F.count_distinct(F.when(kept, F.col("page"))).alias("n_pages"),
    )


def kept_pages(label_set: DataFrame) -> DataFrame:
    return label_set.where("reason is null").select("page").distinct()
