"""N-gram counts of pairs of sequences, a whole batch of pairs at a time, exact.

A side of a batch is its rows' items in one array and where each row starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Side = tuple[np.ndarray, np.ndarray]  # items; per row the first item's place, and one place more

STATS = ("n_hyp", "n_ref", "n_match", "n_shared", "n_counted")
_TOGETHER = 1 << 19  # items of both sides that are sorted together


def text_sides(*texts: pa.Array) -> list[Side]:
    """Characters as integers from 1, numbered alike on all sides; a null text has none."""
    whole = [pa.concat_arrays([pc.fill_null(t, "")]) for t in texts]
    codes, starts = [], []
    for t in whole:
        _, offsets, data = t.buffers()
        edges = np.frombuffer(offsets, np.int32)[t.offset:t.offset + len(t) + 1]
        used = (data.to_pybytes() if data else b"")[edges[0]:edges[-1]]
        codes.append(np.frombuffer(used.decode().encode("utf-32-le"), np.uint32))
        starts.append(np.concatenate([[0], np.cumsum(pc.utf8_length(t).to_numpy(zero_copy_only=False), dtype=np.int64)]))
    seen = np.zeros(0x110000, bool)
    for c in codes:
        seen[c] = True
    number = np.cumsum(seen, dtype=np.int32)
    return [(number[c], s) for c, s in zip(codes, starts)]


def token_sides(*lists: pa.Array) -> list[Side]:
    """Tokens as integers from 1, numbered alike on all sides; a null list has none."""
    values = [pc.list_flatten(t) for t in lists]
    ids = pa.concat_arrays(values).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    starts = [np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
              for t in lists]
    cuts = np.cumsum([len(v) for v in values])[:-1]
    return list(zip(np.split(ids, cuts), starts))


def row_ranges(starts: Sequence[np.ndarray], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` items on all sides, one row at least."""
    total = sum(starts)
    first, rows = 0, len(total) - 1
    while first < rows:
        stop = max(first + 1, int(np.searchsorted(total, total[first] + most, side="right")) - 1)
        yield first, min(stop, rows)
        first = min(stop, rows)


def gram_counts(ref: Side, hyp: Side, orders: Sequence[int]) -> np.ndarray:
    """rows x orders x `STATS`, orders ascending.

    ``n_match`` clips at the reference's count; ``n_shared`` counts every
    hypothesis n-gram the reference has at all; ``n_counted`` is ``n_hyp`` where
    the reference has n-grams of that order, else 0.
    """
    rows = len(ref[1]) - 1
    out = np.zeros((rows, len(orders), len(STATS)), np.int64)
    for first, stop in row_ranges([ref[1], hyp[1]], _TOGETHER):
        sides = [(items[s[first]:s[stop]], s[first:stop + 1] - s[first]) for items, s in (ref, hyp)]
        out[first:stop] = _piece_counts(sides, list(orders))
    return out


def _piece_counts(sides: list[Side], orders: list[int]) -> np.ndarray:
    """Sort all positions once by (row, next items); n-grams of every order are then runs."""
    rows = len(sides[0][1]) - 1
    out = np.zeros((rows, len(orders), len(STATS)), np.int64)
    lengths = [np.diff(starts) for _, starts in sides]
    items = np.concatenate([codes for codes, _ in sides]).astype(np.int32)
    if not len(items):
        return out
    row = np.concatenate([np.repeat(np.arange(rows, dtype=np.int32), n) for n in lengths])
    left = np.concatenate([np.repeat(starts[1:], n) - np.arange(len(codes)) for (codes, starts), n in zip(sides, lengths)])
    is_ref = np.arange(len(items)) < len(sides[0][0])
    longest = orders[-1]
    padded = np.concatenate([items, np.zeros(longest, np.int32)])
    ahead = [np.where(left > k, padded[k:k + len(items)], 0) for k in range(longest)]  # 0 beyond the row's end

    # As many columns to a 64-bit key as fit.
    width = [max(1, rows - 1).bit_length()] + [int(items.max()).bit_length()] * longest
    keys: list[np.ndarray] = []
    room = 0
    for bits, column in zip(width, [row, *ahead]):
        if bits > room:
            keys.append(np.zeros(len(items), np.uint64))
            room = 64
        keys[-1] = (keys[-1] << np.uint64(bits)) | column.astype(np.uint64)
        room -= bits
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])

    row, is_ref = row[order], is_ref[order]
    starts = np.empty(len(order), bool)
    starts[0] = True
    starts[1:] = row[1:] != row[:-1]
    for n in range(1, longest + 1):
        item = ahead[n - 1][order]
        starts[1:] |= item[1:] != item[:-1]
        if n not in orders:
            continue
        at = np.flatnonzero(starts)
        in_ref = np.add.reduceat(((item > 0) & is_ref).astype(np.int64), at)
        in_hyp = np.add.reduceat(((item > 0) & ~is_ref).astype(np.int64), at)
        here, place = row[at], orders.index(n)
        for stat, n_each in enumerate((in_hyp, in_ref, np.minimum(in_hyp, in_ref), np.where(in_ref > 0, in_hyp, 0))):
            out[:, place, stat] = np.bincount(here, n_each, rows)
    out[:, :, 4] = np.where(out[:, :, 1] > 0, out[:, :, 0], 0)
    return out
