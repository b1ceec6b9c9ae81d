"""Edit-distance metrics over pairs of columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codec import pack_indices
from .expr import col


def edit_distance(ref: Column | str, hyp: Column | str) -> Column:
    """Levenshtein distance over code points; equal texts skip the table."""
    ref, hyp = col(ref), col(hyp)
    return F.when(ref == hyp, F.lit(0)).otherwise(F.levenshtein(ref, hyp))


def distance(a: str, b: str) -> int:
    """Levenshtein distance with a whole column of the table held as bits of two integers (Myers; Hyyrö).

    ``rises`` and ``falls`` mark the rows where the column grows or shrinks by one.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, edits = every, 0, len(a)
    for c in b:
        here = places.get(c, 0)
        level = here | falls
        diagonal = (((here & rises) + rises) ^ rises) | here
        up, down = falls | (every & ~(diagonal | rises)), rises & diagonal
        if up & last:
            edits += 1
        elif down & last:
            edits -= 1
        up, down = (up << 1) | 1, down << 1
        rises, falls = every & (down | ~(level | up)), every & up & level
    return edits


@F.arrow_udf(T.IntegerType())
def _distances(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    """Distance of each pair; -1 where the lengths alone put it beyond ``most``."""
    def one(x, y, n):
        if x is None or y is None:
            return None
        if x == y:
            return 0
        return -1 if abs(len(x) - len(y)) > n else distance(x, y)

    return pa.array(map(one, a.to_pylist(), b.to_pylist(), most.to_pylist()), pa.int32())


def cer(ref: Column | str, hyp: Column | str) -> Column:
    """Distance over reference length; an empty reference costs one per character."""
    ref, hyp = col(ref), col(hyp)
    return (
        F.when(F.char_length(ref) == 0, F.char_length(hyp).cast("double"))
        .otherwise(edit_distance(ref, hyp) / F.char_length(ref))
    )


def agreement_cer(a: Column | str, b: Column | str) -> Column:
    """Symmetric disagreement in [0, 1]; two empty texts agree."""
    a, b = col(a), col(b)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(_distances(a, b, longest) / longest)


def agreement_within(a: Column | str, b: Column | str, limit: float) -> Column:
    """`agreement_cer` up to ``limit``, and 1 beyond; pairs whose lengths differ by more are not compared."""
    a, b = col(a), col(b)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    most = F.floor(longest * limit).cast("int")
    edits = _distances(a, b, most)
    return F.when(longest == 0, F.lit(0.0)).when((edits < 0) | (edits > most), F.lit(1.0)).otherwise(edits / longest)


def symbol_cer(ref_ids: Column | str, hyp_ids: Column | str, n_classes: int) -> Column:
    """CER over class-index arrays."""
    return cer(pack_indices(ref_ids, n_classes), pack_indices(hyp_ids, n_classes))
