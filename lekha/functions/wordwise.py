"""Rules on words, applied once per distinct word of a batch.

A rule that never looks past a space gives the same text whether it sees the
text or its words one by one. Texts repeat their words, so a batch is cut at
spaces, its distinct words are rewritten and put back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 12 << 20  # bytes of text cut into words at a time


def _slices(texts: pa.Array):
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size, dtype=np.int64), 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _words(texts: pa.Array, space: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of every word that occurs, and where each text's words start."""
    lists = pc.split_pattern(texts, space)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), offsets - offsets[0]


def _rewritten(texts: pa.Array, rule: Callable[[str], str], space: str, joint: str, bad: str | None, full: bool) -> pa.Array:
    old, index, offsets = _words(texts, space)
    null = pc.is_null(texts).to_numpy(zero_copy_only=False)

    def before(flags: pa.Array) -> np.ndarray:
        """Words with the flag that stand before each text's first word, and in all."""
        return np.concatenate([[0], np.cumsum(flags.to_numpy(zero_copy_only=False)[index], dtype=np.int64)])[offsets]

    if bad is not None and len(old):
        wrong = pc.match_substring_regex(old, bad)
        null = null | (np.diff(before(wrong)) > 0)
        old = pc.if_else(wrong, "", old)
    together = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(old)], pa.int32()), old), space)
    new = pc.split_pattern(pa.array([rule(together[0].as_py())], pa.string()), space).values
    if full:  # newlines inside words are spaces; empty words go, and the spaces beside them
        new = pc.utf8_trim(pc.replace_substring_regex(new, "\n+", " "), " ")
        keep = pc.greater(pc.binary_length(new), 0)
        offsets, index = before(keep), index[keep.to_numpy(zero_copy_only=False)[index]]
    parts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), new.take(pa.array(index)))
    return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), pc.binary_join(parts, joint))


def rewrite(texts: pa.Array, rule: Callable[[str], str], space: str = " ", joint: str = " ", bad: str | None = None,
            full: bool = False) -> pa.Array:
    """Each text with its words, which ``space`` parts, rewritten by ``rule`` and joined by ``joint``.

    The rule gets distinct words in one string, parted by ``space``, and keeps
    every ``space``. A text with a word that matches ``bad`` is null, as is a
    null text. With ``full``, newlines in rewritten words are spaces, runs of
    spaces become one, and none is left at the ends.
    """
    parts = [_rewritten(part.cast(pa.string()), rule, space, joint, bad, full) for part in _slices(texts)]
    return pa.concat_arrays(parts).cast(texts.type) if parts else texts


def _counted(texts: pa.Array, rules: Sequence[re.Pattern], space: str) -> pa.Array:
    words, index, offsets = _words(texts, space)
    sums = np.zeros((len(texts), len(rules)), np.int32)
    ends = np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64) + 1)
    together = space.join(words.to_pylist())
    for k, rule in enumerate(rules):
        places = np.fromiter((m.start() for m in rule.finditer(together)), np.int64)
        each = np.bincount(np.searchsorted(ends, places, side="right"), minlength=len(words))
        sums[:, k] = np.diff(np.concatenate([[0], np.cumsum(each[index])])[offsets])
    starts = pa.array(np.arange(len(texts) + 1) * len(rules), pa.int32())
    lists = pa.ListArray.from_arrays(starts, pa.array(sums.reshape(-1)))
    return pc.if_else(pc.is_null(texts), pa.scalar(None, lists.type), lists)


def count(texts: pa.Array, rules: Sequence[re.Pattern], space: str = " ") -> pa.Array:
    """How often each rule matches in each text; a rule never matches a ``space``, one character, and looks past none. A null text has null."""
    parts = [_counted(part.cast(pa.string()), rules, space) for part in _slices(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
