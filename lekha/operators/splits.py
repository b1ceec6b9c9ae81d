"""Splits and samples. Draws are hashes of keys: deterministic, independent of
partitioning, and of the exact size asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw, draw_chunk, in_hash_split
from .ranking import join_null_safe, sample_n, with_rank, with_running_sum


def hash_split(df: DataFrame, key: str, prefix: str, threshold: int, name: str = "is_test") -> DataFrame:
    return df.withColumn(name, in_hash_split(key, prefix, threshold))


def frozen_split(df: DataFrame, frozen: DataFrame, key: str, prefix: str, threshold: int,
                 name: str = "is_test") -> DataFrame:
    """A frozen assignment ``(key, is_test)`` wins; new keys follow the hash."""
    known = frozen.select(key, F.col(name).alias("__frozen"))
    return df.join(known, key, "left").withColumn(
        name, F.coalesce("__frozen", in_hash_split(key, prefix, threshold))).drop("__frozen")


def fill_to(df: DataFrame, test: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """All test rows, and sampled other rows up to n in total."""
    held = df.where(F.col(test))
    room = held.agg(F.greatest(F.lit(n) - F.count(F.lit(1)), F.lit(0))).scalar()
    return held.unionByName(sample_n(df.where(~F.col(test)), [key], room, seed))


def sample_pages(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct pages; a pool that is too small fails the job."""
    pages = df.select(key).distinct()
    enough = pages.agg(F.when(F.count(F.lit(1)) >= n, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"fewer than {n} pages")).cast("boolean")))
    return sample_n(pages, [key], n, seed).where(enough.scalar())


def stratified(df: DataFrame, group: str, key: str, limit: int, seed: int = 0) -> DataFrame:
    """ceil(limit / groups) rows of each group, cut to the limit in group order.

    Everything is returned when the limit covers the table.
    """
    groups = df.agg(F.count_distinct(group)).scalar()
    total = df.agg(F.count(F.lit(1))).scalar()
    per = F.ceil(F.lit(limit) / groups)
    drawn = df.withColumn("__draw", draw(seed, key))
    within = with_rank(drawn, [group], ["__draw", key], draw_chunk("__draw"), "__in_group",
                       at_most=F.when(total <= limit, total).otherwise(per))
    # Every group keeps a row, so at most ``limit`` groups can matter.
    kept = within.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).orderBy(group).limit(limit)
    offset = kept.select(group, _sum_before("__n", group).alias("__offset"))
    out = join_null_safe(within, offset, [group]).where(F.col("__offset") + F.col("__in_group") <= limit)
    return out.drop("__draw", "__in_group", "__offset")


def _sum_before(amount: str, *order: str) -> Column:
    """Running sum of the rows before, for a table of bounded size."""
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(w), F.lit(0))


def whole_pages(df: DataFrame, page: str, position: str, limit: int, group: Column | None = None) -> DataFrame:
    """Whole pages in (group, page) order until at least ``limit`` rows, then cut.

    Page sizes come from counting, so rows are never ordered globally.
    """
    grouped = df.withColumn("__g", F.lit("") if group is None else group)
    sizes = grouped.groupBy("__g", page).agg(F.count(F.lit(1)).alias("__n")).orderBy("__g", page).limit(limit)
    starts = sizes.withColumn("__before", _sum_before("__n", "__g", page)).where(F.col("__before") < limit)
    rows = join_null_safe(grouped, starts.select("__g", page, "__before"), ["__g", page])
    ranked = with_rank(rows, ["__g", page], [position], F.floor(F.col(position) / 65536), "__pos")
    return ranked.where(F.col("__before") + F.col("__pos") <= limit).drop("__g", "__before", "__pos")


def pages_to_budget(df: DataFrame, group: str, key: str, amount: str, budget: int, seed: int = 0) -> DataFrame:
    """Per group, pages in hash order until their amounts reach the budget;
    the last page may overshoot."""
    drawn = df.withColumn("__draw", draw(seed, key))
    taken = with_running_sum(drawn, [group], ["__draw", key], draw_chunk("__draw"), F.col(amount), "__before",
                             at_most=budget - 1)
    return taken.drop("__draw", "__before")


def holdout_every(df: DataFrame, page: str, order: Sequence[str], n: int, chunk: Column,
                  name: str = "demo_split") -> DataFrame:
    """Every nth row of each page is held out; n <= 1 holds out nothing."""
    if n <= 1:
        return df.withColumn(name, F.lit("train"))
    ranked = with_rank(df, [page], order, chunk, "__k")
    return ranked.withColumn(
        name, F.when(F.pmod(F.col("__k") - 1, F.lit(n)) == n - 1, F.lit("holdout")).otherwise(F.lit("train"))
    ).drop("__k")


def split_with_override(df: DataFrame, given: str, key: str, prefix: str, threshold: int,
                        name: str = "is_validation") -> DataFrame:
    """A given split column, when any row has it, replaces the hash split."""
    any_given = df.agg(F.coalesce(F.bool_or(F.col(given).isNotNull()), F.lit(False))).scalar()
    held = F.coalesce(F.col(given) == "holdout", F.lit(False))
    return df.withColumn(name, F.when(any_given, held).otherwise(in_hash_split(key, prefix, threshold)))


def learning_curve(df: DataFrame, key: str, sizes: Sequence[int], seed: int = 0) -> DataFrame:
    """Nested subsets: the row's smallest subset size, one row per membership."""
    ranked = with_rank(df.withColumn("__draw", draw(seed, key)), [], ["__draw", key], draw_chunk("__draw"),
                       "__rank", at_most=max(sizes))
    member = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col("__rank") <= s)
    return ranked.withColumn("subset", F.explode(member)).drop("__draw", "__rank")


def hash_permutation_split(df: DataFrame, key: str, fraction: float, seed: int = 0,
                           name: str = "is_test") -> DataFrame:
    """Exactly floor(n x fraction) rows are test rows."""
    n_test = df.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction))).scalar()
    ranked = with_rank(df.withColumn("__draw", draw(seed, key)), [], ["__draw", key], draw_chunk("__draw"), "__rank")
    return ranked.withColumn(name, F.col("__rank") <= n_test).drop("__draw", "__rank")


def replay_mix(own: DataFrame, other: DataFrame, key: str, ratio: float, n_validation: int,
               is_validation: str, seed: int = 0) -> DataFrame:
    """Own rows, floor(ratio x own) rows of the other set's train part, and the
    first ``n_validation`` of its validation part."""
    room = own.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio))).scalar()
    replay = sample_n(other.where(~F.col(is_validation)), [key], room, seed)
    fixed = sample_n(other.where(F.col(is_validation)), [key], n_validation, "validation")
    parts = [own.withColumn("origin", F.lit("own")), replay.withColumn("origin", F.lit("replay")),
             fixed.withColumn("origin", F.lit("replay_validation"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
