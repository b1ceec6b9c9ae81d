"""Grouping rows into bounded batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .ranking import with_rank


def page_batches(df: DataFrame, page: str, position: str, size: int) -> DataFrame:
    """Consecutive rows of one page, at most ``size`` per batch."""
    ranked = with_rank(df, [page], [position], F.floor(F.col(position) / 65536), "__k")
    return ranked.withColumn("batch", F.floor((F.col("__k") - 1) / size)).drop("__k")


def budget_batches(df: DataFrame, key: str, height: Column, width: Column, budget: int, max_rows: int,
                   drop_single: bool = False, partitions: int | None = None) -> DataFrame:
    """Greedy batches, numbered from 0, of rows in order of area: rows x max height x max width <= budget.

    Equal to one pass over all rows, yet no task sees more than its range of
    areas. A batch that reaches into the next range ends within that range's
    first ``max_rows`` rows, so each range reports those rows and, for every
    place among them where its first own batch may start, how many batches
    follow and what the last one holds. Following these short reports range by
    range gives every range its true start. A row that exceeds the budget alone
    forms a batch of one; filter such rows first if they cannot be used.
    ``drop_single`` drops the last batch if it has one row. Rows of equal area
    go by ``key``, which should be unique; a null size counts as 0.
    """
    size = [F.coalesce(c.cast("long"), F.lit(0)) for c in (height, width)]
    sized = df.select(key, size[0].alias("h"), size[1].alias("w")).withColumn("area", F.col("h") * F.col("w"))
    ranged = sized.repartitionByRange(partitions, "area", key) if partitions else sized.repartitionByRange("area", key)
    # Range borders come from a sample: they are written down so that both passes see the same.
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "ranges")

    def ordered(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("area", "ascending"), (key, "ascending")], null_placement="at_start")
        return table.take(order)

    def report(table: pa.Table) -> pa.Table:
        table = ordered(table)
        h, w = (table.column(c).to_numpy() for c in ("h", "w"))
        ends = batch_ends(h, w, budget, max_rows)
        batches, last = follow(ends, np.arange(min(max_rows, len(h) - 1) + 1))
        state = [[int(b), len(h) - int(s), int(h[s:].max()), int(w[s:].max())] for b, s in zip(batches, last)]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "rows": pa.array([len(h)], pa.int64()),
                         "h": pa.array([h[:max_rows]], pa.list_(pa.int64())), "w": pa.array([w[:max_rows]], pa.list_(pa.int64())),
                         "ends": pa.array([state], pa.list_(pa.list_(pa.int64())))})

    reports = ranged.groupBy("part").applyInArrow(report, "part int, rows long, h array<long>, w array<long>, ends array<array<long>>")
    starts = chain_reports(sorted(reports.collect(), key=lambda r: r["part"]), budget, max_rows)
    total, lone = starts.pop()
    begin = df.sparkSession.createDataFrame(starts, "part int, number long, first int")

    def number(table: pa.Table) -> pa.Table:
        table = ordered(table)
        first, at = table.column("first")[0].as_py(), table.column("number")[0].as_py()
        ends = batch_ends(table.column("h").to_numpy(), table.column("w").to_numpy(), budget, max_rows)
        opens = np.zeros(table.num_rows, np.int64)
        while first < table.num_rows:
            opens[first], first = 1, int(ends[first])
        return pa.table({key: table.column(key), "h": table.column("h"), "w": table.column("w"), "batch": pa.array(at + np.cumsum(opens))})

    out = T.StructType([df.schema[key], *[T.StructField(n, T.LongType()) for n in ("h", "w", "batch")]])
    numbered = ranged.join(F.broadcast(begin), "part").groupBy("part").applyInArrow(number, out)  # one row per range
    return numbered.where(F.col("batch") < total - 1) if drop_single and lone else numbered


def batch_ends(h: np.ndarray, w: np.ndarray, budget: int, max_rows: int) -> np.ndarray:
    """For every row, where a batch that starts there ends: the first row that no longer fits, or one past the last."""
    n = len(h)
    ends = np.minimum(np.arange(n) + 1, n)
    top_h, top_w = h.copy(), w.copy()
    open_ = np.arange(n)  # starts whose batch has taken every row so far
    for size in range(2, max_rows + 1):
        open_ = open_[open_ + size <= n]
        new = open_ + size - 1
        top_h[open_], top_w[open_] = np.maximum(top_h[open_], h[new]), np.maximum(top_w[open_], w[new])
        open_ = open_[size * top_h[open_] * top_w[open_] <= budget]
        if not len(open_):
            break
        ends[open_] = open_ + size
    return ends


def follow(ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each start, one past the last row included: how many batches follow and where the last one starts."""
    n = len(ends)
    count, last, at = np.zeros(len(starts), np.int64), np.minimum(starts, n - 1), starts.copy()
    live = np.flatnonzero(at < n)
    while len(live):
        count[live] += 1
        last[live] = at[live]
        at[live] = ends[at[live]]
        live = live[at[live] < n]
    return count, last


def chain_reports(reports: list, budget: int, max_rows: int) -> list[tuple]:
    """(part, number of the batch open when the range begins, first row that opens a batch) per range, then (batches, last one is alone)."""
    out, opened, held = [], 0, (0, 0, 0)  # rows and maxima of the open batch
    for r in reports:
        n, top_h, top_w = held
        first = 0
        while n and first < len(r["h"]):
            new_h, new_w = max(top_h, r["h"][first]), max(top_w, r["w"][first])
            if n >= max_rows or (n + 1) * new_h * new_w > budget:
                break
            n, top_h, top_w, first = n + 1, new_h, new_w, first + 1
        out.append((r["part"], opened - 1, first))
        if first < r["rows"]:
            batches, *held = r["ends"][first]
            opened += batches
        else:
            held = (n, top_h, top_w)
    return [*out, (opened, held[0] == 1)]


def length_batches(df: DataFrame, key: str, length: Column, max_tokens: int, max_rows: int) -> DataFrame:
    """Greedy batches with rows x max length <= max_tokens."""
    packed = budget_batches(df, key, F.lit(1), length, max_tokens, max_rows)
    return packed.select(key, F.col("w").alias("length"), "batch")
