"""Ranks, running sums and exact percentiles that survive hot groups.

A plain window sends a whole group to one task. The functions here work on
(group, chunk) pieces, where ``chunk`` is an integer that never decreases
along the order (a position divided by a constant, or the leading digits of a
hash), and add per-chunk offsets, which are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw, draw_chunk
from ..functions.orderkey import from_order_key, order_key

_CHUNK, _OFFSET, _TOTAL, _CONST = "__chunk", "__offset", "__total", "__all"
_SHIFTS = (42, 21, 0)  # a percentile's cells are cut at the leading 22 bits, then 21 further, then at the last
_FITS = 1 << 16  # a cell with no more different values is counted value by value at once


def _offsets(df: DataFrame, group: Sequence[str], amount: Column) -> DataFrame:
    """Sum of ``amount`` over the earlier chunks of each group."""
    per_chunk = df.groupBy(*group, _CHUNK).agg(F.sum(amount).alias(_TOTAL))
    before = W.partitionBy(*group).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return per_chunk.select(
        *group, _CHUNK, F.coalesce(F.sum(_TOTAL).over(before), F.lit(0)).alias(_OFFSET)
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join on columns of equal names in which null equals null."""
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for k, other in names.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    return left.join(renamed, same).drop(*names.values())


def with_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], chunk: Column,
              name: str = "rank", at_most: int | Column | None = None) -> DataFrame:
    """Exact row number from 1 within each group, in the given order.

    ``at_most`` keeps only the first rows of each group and skips every chunk
    that starts beyond them before anything is sorted.
    """
    return with_running_sum(df, group, order, chunk, F.lit(1).cast("bigint"), name, at_most, inclusive=True)


def with_running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], chunk: Column,
                     amount: Column, name: str, at_most: int | Column | None = None,
                     inclusive: bool = False) -> DataFrame:
    """Exact running sum of ``amount`` over the group's earlier rows.

    With ``inclusive`` the row itself counts too. ``at_most`` drops rows
    whose sum exceeds it. Null groups and null chunks count as values.
    """
    group = list(group)
    chunked = df.withColumn(_CHUNK, chunk)
    offsets = _offsets(chunked, group, amount)
    if at_most is not None:
        offsets = offsets.where(F.col(_OFFSET) <= at_most)
    joined = join_null_safe(chunked, offsets, [*group, _CHUNK])
    inner = W.partitionBy(*group, _CHUNK).orderBy(*order)
    inner = inner.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = joined.withColumn(name, F.col(_OFFSET) + F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    if at_most is not None:
        out = out.where(F.col(name) <= at_most)
    return out.drop(_CHUNK, _OFFSET)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key. The limit runs before the shuffle, so copies of
    one key never meet in a single task."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def sample_n(df: DataFrame, key: Sequence[str], n: int | Column, seed: int | str = 0,
             group: Sequence[str] = ()) -> DataFrame:
    """Exactly n rows (per group) drawn without replacement by hash order."""
    drawn = df.withColumn("__draw", draw(seed, *key))
    ranked = with_rank(drawn, group, ["__draw", *key], draw_chunk("__draw"), "__rank", at_most=n)
    return ranked.drop("__draw", "__rank")


def _cells(rows: DataFrame, keys: Sequence[str], parent: Sequence[str]) -> DataFrame:
    """Rows counted by (keys, parent, cell), with the values' count before each cell of a parent."""
    counted = rows.groupBy(*keys, *parent, "shift", F.call_function("shiftright", F.col("k"), F.col("shift")).alias("cell")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("different"))
    whole = W.partitionBy(*keys, *parent)
    upto = whole.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0))).withColumn("all", F.sum("c").over(whole))


def _wanted(cells: DataFrame, keys: Sequence[str], base: Column, ranks: Column) -> DataFrame:
    """The cells that hold wanted ranks, those ranks, and how finely to cut the cell next."""
    # A lambda would take a name of the same select for the input's: hence two steps.
    placed = cells.withColumn("from", base + F.col("before")).withColumn(
        "mine", F.filter(ranks, lambda r: (r >= F.col("from")) & (r < F.col("from") + F.col("c")))).where(F.size("mine") > 0)
    return placed.select(
        *keys, "n", F.col("cell").alias("of"), F.col("shift").alias("of_shift"), F.col("from").alias("base"), F.col("mine").alias("ranks"),
        F.when((F.col("different") <= _FITS) | (F.col("shift") < _SHIFTS[0]), _SHIFTS[2]).otherwise(_SHIFTS[1]).alias("shift"))


def exact_percentiles(df: DataFrame, value: str, at: Sequence[float], group: Sequence[str] = (),
                      weight: str | None = None) -> DataFrame:
    """Exact interpolated percentiles, one row per group: ``p`` array and ``n``.

    Selection by refining a histogram: values become integers of the same order
    (`order_key`), equal ones are counted, and the counts per leading 22 bits
    tell which cells hold the wanted ranks. Those cells alone are cut further,
    twice where a cell holds very many different values, until each has one.
    Every step adds up counts; what it orders are cells, whose number the bits
    bound, so no task ever holds a group's rows. Null values do not count; null
    groups do. ``weight`` names a column of whole numbers: how often a row counts.
    """
    group = list(group)
    keys = group or [_CONST]
    count = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = df.where(F.col(value).isNotNull()).select(*group, order_key(value).alias("k"), count.alias("c"))
    if not group:
        rows = rows.withColumn(_CONST, F.lit(0))
    # Every round reads this one shuffle again.
    weights = rows.groupBy(*keys, "k").agg(F.sum("c").alias("c")).where("c > 0")

    # Ranks on both sides of each wanted place; the last row has rank n - 1.
    places = [F.lit(q) * (F.col("n") - 1) for q in at]
    ranks = F.array_distinct(F.array(*[end(p).cast("long") for p in places for end in (F.floor, F.ceil)]))
    first = _cells(weights.withColumn("shift", F.lit(_SHIFTS[0])), keys, []).withColumnRenamed("all", "n")
    chosen = _wanted(first, keys, F.lit(0), ranks)
    for _ in _SHIFTS[1:]:  # a cell with one value matches that one row again
        inside = join_null_safe(weights, chosen, keys).where(F.call_function("shiftright", F.col("k"), F.col("of_shift")) == F.col("of"))
        chosen = _wanted(_cells(inside, keys, ["n", "base", "ranks"]), keys, F.col("base"), F.col("ranks"))

    values = chosen.select(*keys, "n", F.explode("ranks").alias("r"), from_order_key("of").alias("v"))
    by_rank = values.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_set(F.struct("r", "v"))).alias("v"))

    def exact(place: Column) -> Column:
        low, high = (F.element_at("v", end(place).cast("long")) for end in (F.floor, F.ceil))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise(low + (high - low) * (place - F.floor(place)))

    return by_rank.select(*group, "n", F.array(*[exact(p) for p in places]).alias("p"))


def exact_median(df: DataFrame, value: str, group: Sequence[str] = (), name: str = "median") -> DataFrame:
    return exact_percentiles(df, value, [0.5], group).select(*group, "n", F.col("p")[0].alias(name))
