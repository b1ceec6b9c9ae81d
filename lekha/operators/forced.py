"""Forced alignment of known symbols to frames, and what it shows.

No line is lost without a trace: the aligner gives every line it cannot use one
row that says why (``status``), and scans, spans and reports carry that on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alignment import best_labellings
from ..functions.vectors import argmax, softmax, top_k
from .frames import BLANK, runs
from .ranking import exact_percentiles

PIXELS_PER_FRAME = 8
BLOCK_CELLS = 4_000_000  # scores of complete lines a task holds before it aligns them
# A cut glyph is dropped below 2 px or above a quarter of its line.
LEAST_GLYPH_PX = 2
MAX_SPAN_SHARE = 0.25
# What became of a line.
ALIGNED, UNENCODABLE, UNALIGNABLE, MISMATCHED = "aligned", "unencodable", "unalignable", "mismatched"


def forced_align(frames: DataFrame, targets: DataFrame, line: str = "line_id") -> DataFrame:
    """True label per frame: (line, frame, label, status).

    ``targets(line, targets array<int>)``. Each line's targets travel once, as
    a header row sorted before its frames; a task then walks its lines as a
    stream and aligns complete lines in blocks of bounded size. A line that
    cannot be aligned gives one row with a NULL frame: its status is
    ``unencodable`` if its targets are NULL or hold a NULL or a class the frames
    do not have, ``unalignable`` if it has no targets or too few frames.
    """
    line_type = frames.schema[line].dataType
    out = T.StructType([
        T.StructField(line, line_type), T.StructField("frame", T.IntegerType()),
        T.StructField("label", T.IntegerType()), T.StructField("status", T.StringType()),
    ])
    header = targets.select(
        line, F.lit(-1).alias("frame"), F.lit(None).cast("array<float>").alias("lp"),
        F.col("targets").cast("array<int>").alias("targets"),
    )
    body = frames.join(targets.select(line), line, "left_semi").select(
        line, "frame", F.col("log_probs").cast("array<float>").alias("lp"),
        F.lit(None).cast("array<int>").alias("targets"),
    )
    # The hash keeps this shuffle in the plan even where both inputs are already
    # placed by line: no later step would ask for that placement again.
    ordered = header.unionByName(body).repartition(F.xxhash64(line)).sortWithinPartitions(line, "frame")

    arrow_types = [pa.string() if isinstance(line_type, T.StringType) else pa.int64(), pa.int32(), pa.int32(), pa.string()]
    if isinstance(line_type, T.IntegerType):
        arrow_types[0] = pa.int32()

    def aligned(lines: list[tuple]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 1), np.float32)
        found = best_labellings([([] if bad else targets, np.concatenate(parts) if parts else none)
                                 for _, targets, parts, bad in lines], BLANK)
        keys, frame, label, status = [], [], [], []
        for (key, _, _, bad), labels in zip(lines, found):
            keys += [key] * (1 if labels is None else len(labels))
            frame += [None] if labels is None else range(len(labels))
            label += [None] if labels is None else labels.tolist()
            status += [UNENCODABLE if bad else UNALIGNABLE] if labels is None else [ALIGNED] * len(labels)
        arrays = [pa.array(c, type=t) for c, t in zip([keys, frame, label, status], arrow_types)]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[list] = []  # [key, targets, scores by batch, cannot be encoded]; the last one may still grow
        held = 0
        for batch in batches:
            keys, lps, wanted = batch.column(0), batch.column(2), batch.column(3)
            headers = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False) < 0).tolist()
            values, edges = lps.values.to_numpy(zero_copy_only=False), lps.offsets.to_numpy()
            for first, stop in zip([-1, *headers], [*headers, batch.num_rows]):
                if first >= 0:
                    if held > BLOCK_CELLS:
                        yield from aligned(lines)
                        lines, held = [], 0
                    targets = wanted[first].as_py()
                    lines.append([keys[first].as_py(), targets or [], [], targets is None or None in targets])
                if stop > first + 1 and lines[-1][1] and not lines[-1][3]:
                    vectors = values[edges[first + 1]:edges[stop]].reshape(stop - first - 1, -1)
                    lines[-1][3] = not 0 <= min(lines[-1][1]) <= max(lines[-1][1]) < vectors.shape[1]
                    if not lines[-1][3]:
                        lines[-1][2].append(vectors[:, [BLANK, *lines[-1][1]]])
                        held += lines[-1][2][-1].size
        if lines:
            yield from aligned(lines)

    return ordered.mapInArrow(run, out)


def recovery_scan(frames: DataFrame, labels: DataFrame, temperature: float, k: int = 5,
                  line: str = "line_id") -> DataFrame:
    """Every aligned non-blank frame: was it read wrong, and was the truth kept?

    ``rank`` counts from 1 and is NULL where the truth is not in the top k. A
    line without an alignment keeps its one row: NULL frame and its status.
    """
    scored = (
        frames.select(line, "frame", argmax("log_probs").alias("argmax"), "log_probs",
                      softmax("log_probs", temperature).alias("pr"))
        .select(line, "frame", "argmax", "log_probs", top_k("pr", k).alias("top"))
    )
    real = labels.where((F.col("label") != BLANK) | F.col("frame").isNull()).join(scored, [line, "frame"], "left")
    rank = F.array_position(F.col("top.index"), F.col("label")).cast("int")
    kept = F.when((F.col("argmax") != F.col("label")) & (rank > 0), rank)
    return real.withColumn("wrong", F.col("argmax") != F.col("label")).withColumn("rank", kept).select(
        line, "frame", F.col("label").alias("truth"), "argmax", "wrong", "rank",
        F.get(F.col("top.weight"), F.col("rank") - 1).alias("weight"),
        F.exp(F.get("log_probs", F.col("argmax"))).alias("argmax_confidence"),
        F.exp(F.get("log_probs", F.col("label"))).alias("truth_confidence"),
        (F.col("frame") * PIXELS_PER_FRAME).alias("pixel_start"), "top", "status",
    )


def recovery_totals(scan: DataFrame) -> DataFrame:
    """One row: frames aligned, wrong and recoverable, and the lines that gave none, by reason."""
    wrong, kept = F.count_if("wrong"), F.count("rank")
    return scan.agg(
        F.count("frame").alias("aligned_frames"), wrong.alias("wrong_frames"), kept.alias("recoverable_frames"),
        F.when(wrong > 0, kept / wrong).alias("recoverable_share"),
        F.coalesce(F.avg("weight"), F.lit(0.0)).alias("mean_weight"),
        F.count_if(F.col("status") == UNALIGNABLE).alias("unalignable"),
        F.count_if(F.col("status") == UNENCODABLE).alias("unencodable"),
    )


def top_examples(scan: DataFrame, n: int, line: str = "line_id") -> DataFrame:
    """The n recoverable frames that kept most weight on the truth."""
    return scan.where("rank is not null").orderBy(F.desc("weight"), line, "frame").limit(n)


def _spans(labels: DataFrame, line: str) -> DataFrame:
    return runs(labels.where("frame is not null"), "label", line).where("slot is not null")


def line_outcomes(labels: DataFrame, targets: DataFrame, line: str = "line_id") -> DataFrame:
    """(line, status, n_targets, n_spans) of every line of ``targets``: one of the four outcomes.

    A line counts as ``mismatched`` if its labels have another number of spans
    than it has targets, as a double letter without a blank between would. With
    spans beside it, ``labels`` is read more than once; store it first.
    """
    counts = _spans(labels, line).groupBy(line).agg(F.count(F.lit(1)).alias("n_spans"))
    failed = labels.where("frame is null").select(line, "status")

    def beside(df: DataFrame, other: DataFrame) -> DataFrame:
        other = other.withColumnRenamed(line, "__line")
        return df.join(other, F.col(line).eqNullSafe(F.col("__line")), "left").drop("__line")

    sizes = targets.select(line, F.coalesce(F.size("targets"), F.lit(0)).alias("n_targets"))
    rows = beside(beside(sizes, counts), failed).withColumn("n_spans", F.coalesce("n_spans", F.lit(0)))
    sound = F.when(F.col("n_spans") == F.col("n_targets"), ALIGNED).otherwise(MISMATCHED)
    return rows.select(line, F.coalesce("status", sound).alias("status"), "n_targets", "n_spans")


def label_spans(labels: DataFrame, targets: DataFrame, line: str = "line_id") -> DataFrame:
    """Frame span of every aligned symbol, for lines whose span count equals
    their target count. What the other lines lack, `line_outcomes` tells."""
    spans = _spans(labels, line)
    counts = spans.groupBy(line).agg(F.count(F.lit(1)).alias("n_spans"))
    sound = (
        targets.select(line, F.size("targets").alias("n_targets")).join(counts, line)
        .where("n_spans = n_targets").select(line)
    )
    return spans.join(sound, line, "left_semi").select(line, "slot", "label", "first", "last")


def cut_bounds(spans: DataFrame, widths: DataFrame, margin: int = 1, midpoint: bool = False,
               line: str = "line_id") -> DataFrame:
    """Pixel bounds per span. ``widths(line, width)``; ``reason`` tells why a
    cut is dropped and is NULL for a kept one.

    Neighbours are found by joining slot numbers, so a long line needs no
    single ordered pass.
    """
    df = spans
    if midpoint:
        after = spans.select(line, (F.col("slot") - 1).alias("slot"), F.col("first").alias("next_first"))
        before = spans.select(line, (F.col("slot") + 1).alias("slot"), F.col("last").alias("prev_last"))
        df = df.join(after, [line, "slot"], "left").join(before, [line, "slot"], "left")
        low = F.when(F.col("prev_last").isNotNull(), F.floor((F.col("prev_last") + F.col("first") + 1) / 2)).otherwise(
            F.greatest(F.lit(0), F.col("first") - margin))
        high = F.when(F.col("next_first").isNotNull(), F.floor((F.col("last") + F.col("next_first") + 1) / 2)).otherwise(
            F.col("last") + 1 + margin)
    else:
        low, high = F.col("first") - margin, F.col("last") + 1 + margin
    cut = df.join(widths, line).select(
        line, "slot", "label", "width",
        F.greatest(F.lit(0), low * PIXELS_PER_FRAME).cast("int").alias("x0"),
        F.least(F.col("width"), high * PIXELS_PER_FRAME).cast("int").alias("x1"),
    )
    size = F.col("x1") - F.col("x0")
    reason = F.when(size < LEAST_GLYPH_PX, F.lit("empty")).when(
        size / F.col("width") > MAX_SPAN_SHARE, F.lit("too_wide"))
    return cut.withColumn("reason", reason)


def glyph_summary(cuts: DataFrame, vocab_size: int) -> DataFrame:
    """Counts per symbol, rolled up: rare and common symbols, coverage, widths."""
    kept = cuts.where("reason is null").select("label", (F.col("x1") - F.col("x0")).alias("w"))
    per = kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"))
    middle = exact_percentiles(kept, "w", [0.5]).select(F.floor(F.col("p")[0]).cast("int"))
    return per.agg(
        F.sum("n").alias("n_glyphs"), F.count(F.lit(1)).alias("n_symbols"),
        F.round(F.count(F.lit(1)) / vocab_size, 3).alias("coverage"),
        F.count_if(F.col("n") == 1).alias("symbols_with_1"), F.count_if(F.col("n") >= 5).alias("symbols_with_5"),
        F.min("lo").alias("width_min"), F.max("hi").alias("width_max"),
    ).withColumn("width_median", middle.scalar())


def glyph_outcomes(cuts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: lines by outcome, and their glyphs kept and dropped by reason."""
    lines = outcomes.agg(F.count(F.lit(1)).alias("lines"), *[
        F.count_if(F.col("status") == s).alias(f"lines_{s}") for s in (ALIGNED, UNENCODABLE, UNALIGNABLE, MISMATCHED)])
    glyphs = cuts.agg(
        F.count_if(F.col("reason").isNull()).alias("glyphs_kept"), F.count_if(F.col("reason") == "empty").alias("glyphs_empty"),
        F.count_if(F.col("reason") == "too_wide").alias("glyphs_too_wide"))
    return lines.select("*", *[glyphs.select(c).scalar().alias(c) for c in glyphs.columns])


def glyph_yield(cuts: DataFrame, outcomes: DataFrame, line: str = "line_id") -> DataFrame:
    """(line, status, n_targets, n_kept) of every line, those without any glyph included."""
    kept = cuts.where("reason is null").groupBy(F.col(line).alias("__line")).agg(F.count(F.lit(1)).alias("n_kept"))
    return outcomes.join(kept, F.col(line).eqNullSafe(F.col("__line")), "left").select(
        line, "status", "n_targets", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
