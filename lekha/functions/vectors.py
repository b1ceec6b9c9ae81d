"""Per-frame probability vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col, let


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(log_probs: Column | str, temperature: float = 1.0) -> Column:
    def spread(v: Column) -> Column:
        return let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / F.lit(temperature))))

    def normal(e: Column) -> Column:
        return let(_total(e), lambda z: F.transform(e, lambda x: x / z))

    return let(let(col(log_probs), spread), normal)


def argmax(values: Column | str) -> Column:
    """Zero-based index of the largest value, the lowest index on ties."""
    values = col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(probs: Column | str, k: int = 5) -> Column:
    """[(index, weight)] of the k largest, renormalised, best first.

    Equal probabilities rank by lower index.
    """
    ordered = F.slice(
        F.sort_array(F.transform(col(probs), lambda p, i: F.struct((-p).alias("n"), i.alias("i")))), 1, k
    )

    def weigh(kept: Column) -> Column:
        return let(
            F.aggregate(kept, F.lit(0.0), lambda a, s: a - s["n"]),
            lambda z: F.transform(
                kept, lambda s: F.struct(s["i"].cast("int").alias("index"), (-s["n"] / z).alias("weight"))
            ),
        )

    return let(ordered, weigh)


def top1_confidence(log_probs: Column | str) -> Column:
    return F.exp(F.array_max(col(log_probs)))
