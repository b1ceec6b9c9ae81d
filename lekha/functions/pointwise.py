"""Rules on code points, applied to many texts at once.

Texts lie one behind another as an array of code points, each followed by END.
A rule gives such an array for such an array; it sees END like any letter that
it does not know, so nothing reaches from one text into the next. Texts are
taken in pieces whose arrays stay in the processor's cache.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18  # bytes of text rewritten at a time; a longer text is a piece of its own
END = 0x110000  # behind every text
VOID = 0x110001  # a text that holds it is null
GONE = 0x110002  # a character that is left out

Rule = Callable[[np.ndarray], np.ndarray]


def letters(table: dict[str, str]) -> np.ndarray:
    """By code point: what the table gives for it (one character, or none for ""), else itself."""
    out = np.arange(GONE + 1, dtype=np.uint32)
    for c, to in table.items():
        out[ord(c)] = ord(to) if to else GONE
    return out


def kinds(*groups: Iterable[str]) -> np.ndarray:
    """By code point: the number of its group, from 1; 0 without one."""
    out = np.zeros(GONE + 1, np.uint8)
    for number, group in enumerate(groups, 1):
        out[[ord(c) for c in group]] = number
    return out


def every_other(places: np.ndarray) -> np.ndarray:
    """Of sorted places the first of each run of neighbours and every second one after it: what a scan for pairs takes."""
    number = np.arange(len(places))
    first = np.maximum.accumulate(np.where(np.diff(places, prepend=-2) != 1, number, 0))
    return places[(number - first) % 2 == 0]


def present(points: np.ndarray) -> np.ndarray:
    """Without what is left out."""
    return points.compress(points != GONE)


def marked(points: np.ndarray, places: np.ndarray, mark: str) -> np.ndarray:
    """The mark behind the code points at these places (sorted)."""
    times = np.ones(len(points), np.intp)
    times[places] = 2
    out = points.repeat(times)
    out[places + np.arange(1, len(places) + 1)] = ord(mark)
    return out


def joined(points: np.ndarray, kind: np.ndarray, mark: str) -> np.ndarray:
    """The mark behind every code point of kind 1 that none of kind 2 or more follows; what is left out goes."""
    bare = kind == 1
    bare[:-1] &= kind[1:] < 2
    return present(marked(points, np.flatnonzero(bare), mark))


def behind(kind: np.ndarray, wanted: int, first: int = 1) -> np.ndarray:
    """Mask of what has the wanted kind and stands behind the first kind."""
    out = kind == wanted
    out[1:] &= kind[:-1] == first
    out[:1] = False
    return out


def _pieces(texts: pa.Array):
    size = pc.binary_length(texts).to_numpy()
    ends, start = np.cumsum(size, dtype=np.int64), 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _points(texts: pa.Array) -> np.ndarray:
    out = np.frombuffer("\0".join([*texts.to_pylist(), ""]).encode("utf-32-le"), np.uint32).copy()
    out[np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64) + 1) - 1] = END
    return out


def _texts(points: np.ndarray) -> list[str | None]:
    ends, void = np.flatnonzero(points == END), np.flatnonzero(points == VOID)
    together = np.where(points < END, points, 0).tobytes().decode("utf-32-le")
    stops = ends.tolist()
    out: list[str | None] = [together[a:b] for a, b in zip([0, *(e + 1 for e in stops)], stops)]
    for i in np.unique(np.searchsorted(ends, void)).tolist():
        out[i] = None
    return out


def rewrite(texts: pa.Array, *rules: Rule) -> pa.Array:
    """Each text as the rules, one after another, give it; a null text is null."""
    null = pc.is_null(texts)
    parts = [pa.array([], pa.string())]
    for part in _pieces(pc.fill_null(texts.cast(pa.string()), "")):
        points = _points(part)
        for rule in rules:
            points = rule(points)
        parts.append(pa.array(_texts(points), pa.string()))
    return pc.if_else(null, pa.scalar(None, pa.string()), pa.concat_arrays(parts)).cast(texts.type)
