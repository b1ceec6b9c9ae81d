"""Alignment kernels that run inside Arrow batches, many pairs or lines at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .ngrams import Side

_FAR = np.int32(1 << 29)
_SPARE = 8  # diagonals tried beyond the two lengths' difference
_POSITIONS = 1 << 20  # characters of both sides that are aligned together
_CELLS = 1 << 23  # kept rows and back steps of the pairs that advance together


def align_pairs(refs: Side, hyps: Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Minimal edit paths of all pairs: (pair, ref index, hyp index) arrays, -1 where one side has nothing.

    Walking back from the end, a path prefers match or substitution, then
    deletion, then insertion. Pairs of like length advance together, row by row,
    over the diagonals near the main one; a pair whose distance shows that a
    path might leave them is done again over twice as many, so the result is
    that of the whole table. Only every root-of-n-th row is kept; the rows
    between are computed again on the way back. A pair's positions come in
    order and in one piece, the pairs by length.
    """
    n_all, m_all = np.diff(refs[1]), np.diff(hyps[1])
    by_size = np.argsort(n_all + m_all, kind="stable")
    upto = np.cumsum((n_all + m_all)[by_size])
    first = 0
    while first < len(by_size):
        base = upto[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(upto, base + _POSITIONS, side="right")))
        yield _align_group(refs, hyps, by_size[first:stop])
        first = stop


def align_codes(ref: np.ndarray, hyp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one minimal edit path, as `align_pairs` chooses it."""
    sides = [(np.asarray(c), np.array([0, len(c)])) for c in (ref, hyp)]
    _, r, h = next(align_pairs(*sides))
    return r, h


def _padded(side: Side, pairs: np.ndarray, lengths: np.ndarray, before: int, width: int, fill: int) -> np.ndarray:
    """One row of ``width`` per pair: its first ``lengths`` items after ``before`` places, ``fill`` around them."""
    items, starts = side
    out = np.full((len(pairs), width), fill, np.int32)
    place = np.arange(lengths.max(initial=0))
    inside = place < lengths[:, None]
    rows = np.broadcast_to(np.arange(len(pairs))[:, None], inside.shape)[inside]
    at = np.broadcast_to(place, inside.shape)[inside]
    out[rows, before + at] = items[starts[pairs][rows] + at]
    return out


def _equal_ends(refs: Side, hyps: Side, pairs: np.ndarray, shortest: np.ndarray) -> np.ndarray:
    """Length of the common end of each pair: it always matches first on the way back."""
    same, live, k = np.zeros(len(pairs), np.int64), np.arange(len(pairs)), 0
    ends = refs[1][pairs + 1], hyps[1][pairs + 1]
    while live.size:
        live = live[k < shortest[live]]
        live = live[refs[0][ends[0][live] - 1 - k] == hyps[0][ends[1][live] - 1 - k]]
        k += 1
        same[live] = k
    return same


def _align_group(refs: Side, hyps: Side, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.diff(refs[1])[pairs], np.diff(hyps[1])[pairs]
    same = _equal_ends(refs, hyps, pairs, np.minimum(n, m))
    n, m = n - same, m - same
    parts = []
    todo = [(np.flatnonzero(np.maximum(n, m) >= 0), None)]
    while todo:
        some, band = todo.pop()
        if band is None:
            bands = _SPARE << np.ceil(np.log2(np.maximum(np.abs(n - m)[some] / _SPARE, 1))).astype(np.int64)
            todo += [(some[bands == b], int(b)) for b in np.unique(bands)]
            continue
        some = some[np.argsort(-n[some], kind="stable")]
        while some.size:
            rows = int(n[some[0]])
            each = (2 * int(np.sqrt(rows)) + 2) * (2 * band + 1)
            together, some = some[:max(1, _CELLS // each)], some[max(1, _CELLS // each):]
            done, r, h, failed = _solve_band(refs, hyps, pairs[together], n[together], m[together], band)
            parts.append((together[done], r, h))
            if failed.size:
                todo.append((together[failed], 2 * band))
    tail = np.repeat(np.arange(len(pairs)), same)
    back = np.arange(len(tail)) - np.repeat(np.cumsum(same) - same, same)
    pair = np.concatenate([p for p, _, _ in parts] + [tail])
    ref = np.concatenate([r for _, r, _ in parts] + [n[tail] + back])
    hyp = np.concatenate([h for _, _, h in parts] + [m[tail] + back])
    order = np.argsort(pair, kind="stable")  # a pair's tail follows the rest of it
    return pairs[pair[order]], ref[order].astype(np.int32), hyp[order].astype(np.int32)


def _solve_band(refs: Side, hyps: Side, pairs: np.ndarray, n: np.ndarray, m: np.ndarray,
                band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths of pairs, longest reference first, over 2 x band + 1 diagonals.

    Cell b of row i is column i + b - band. Values are stored less their column,
    so a chain of insertions along a row is a running minimum. Returns (place of
    the pair, ref index, hyp index) arrays and the places of pairs whose path
    might leave the band.
    """
    rows, wide = int(n[0]), 2 * band + 1
    ref = _padded(refs, pairs, n, 0, max(1, rows), -2)
    hyp = _padded(hyps, pairs, m, band + 1, rows + wide + 1, -1)
    live = np.searchsorted(-n, -np.arange(rows + 2), side="right")  # pairs with at least i rows
    step = int(np.sqrt(rows)) + 1

    def advance(row: np.ndarray, i: int, ways: np.ndarray | None) -> np.ndarray:
        k = live[i]
        row = row[:k]
        diagonal = row + (hyp[:k, i:i + wide] != ref[:k, i - 1:i]) - np.int32(1)
        above = np.full_like(row, _FAR)
        above[:, :-1] = row[:, 1:] + 1
        best = np.minimum(diagonal, above)
        if i <= band:  # columns up to 0
            best[:, :band - i] = _FAR
            best[:, band - i] = i
        best = np.minimum.accumulate(best, axis=1)
        if ways is not None:
            ways[:k] = np.where(best == diagonal, 0, np.where(best == above, 1, 2))
            if i <= band:
                ways[:k, band - i] = 1
        return best

    row = np.zeros((len(pairs), wide), np.int32)
    row[:, :band] = _FAR
    distance = m.copy()
    kept = []
    for i in range(rows + 1):
        if i:
            row = advance(row, i, None)
        if i % step == 0:
            kept.append(row)
        ends = np.arange(live[i + 1], live[i])
        distance[ends] = row[ends, m[ends] - n[ends] + band] + m[ends]
    sure = distance < 2 * (band + 1) - np.abs(n - m)

    i, j, place = np.where(sure, n, 0), np.where(sure, m, 0), n + m
    path = np.full((2, len(pairs), int((n + m).max(initial=0))), -1, np.int32)
    for block in range(len(kept) - 1, -1, -1):
        base = block * step
        if not (i > base).any():
            continue
        last = min(base + step, rows)
        ways = np.empty((last - base, live[base + 1], wide), np.uint8)
        row = kept[block]
        for k in range(base + 1, last + 1):
            row = advance(row, k, ways[k - base - 1])
        walking = np.flatnonzero(i > base)
        while walking.size:
            wi, wj = i[walking], j[walking]
            way = ways[wi - base - 1, walking, wj - wi + band]
            wi, wj = wi - (way != 2), wj - (way != 1)
            place[walking] -= 1
            path[0, walking, place[walking]] = np.where(way != 2, wi, -1)
            path[1, walking, place[walking]] = np.where(way != 1, wj, -1)
            i[walking], j[walking] = wi, wj
            walking = walking[wi > base]
    owner = np.repeat(np.arange(len(pairs)), j)  # what is left of the hypothesis stands before everything
    at = np.arange(len(owner)) - np.repeat(np.cumsum(j) - j, j)
    path[1, owner, (place - j)[owner] + at] = at
    used = (np.arange(path.shape[2]) >= (place - j)[:, None]) & (np.arange(path.shape[2]) < (n + m)[:, None]) & sure[:, None]
    return np.nonzero(used)[0], path[0][used], path[1][used], np.flatnonzero(~sure)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


Line = tuple[list[int], np.ndarray]  # targets; per frame the score of the blank, then of every target

_TOGETHER = 8_000_000  # cells of the padded block of lines that advance together
_LEAST = np.float32(-1e20)


def frames_needed(targets: list[int]) -> int:
    """Frames a line must have: one per target, one more between equal neighbours."""
    return len(targets) + sum(a == b for a, b in zip(targets, targets[1:]))


def best_labellings(lines: list[Line], blank: int = 0) -> list[np.ndarray | None]:
    """Per line the best label of every frame, or None where the frames cannot hold the targets.

    Lines of similar length advance together, one numpy step per time step.
    """
    out: list[np.ndarray | None] = [None] * len(lines)
    able = [i for i, (targets, scores) in enumerate(lines) if targets and len(scores) >= frames_needed(targets)]
    able.sort(key=lambda i: -len(lines[i][1]))
    group: list[int] = []
    widest = 0
    for i in able:
        width = max(widest, len(lines[i][0]) + 1)
        if group and (len(group) + 1) * width * len(lines[group[0]][1]) > _TOGETHER:
            _solve([lines[j] for j in group], group, out, blank)
            group, width = [], len(lines[i][0]) + 1
        group.append(i)
        widest = width
    if group:
        _solve([lines[j] for j in group], group, out, blank)
    return out


def _solve(group: list[Line], places: list[int], out: list, blank: int) -> None:
    """Advance lines, longest first, in two layers: ``on[k]`` ends on target k,
    ``between[k]`` ends on a blank after k targets."""
    n, wide = len(group), max(len(targets) for targets, _ in group)
    count = np.array([len(scores) for _, scores in group])
    ends = np.array([len(targets) for targets, _ in group])
    scores = np.zeros((count[0], n, wide + 1), np.float32)
    wanted = np.full((n, wide), blank, np.int32)
    for i, (targets, own) in enumerate(group):
        scores[:len(own), i, :len(targets) + 1] = np.maximum(own, _LEAST)
        wanted[i, :len(targets)] = targets
    adjacent = np.zeros((n, wide), bool)  # may follow the target before it without a blank
    adjacent[:, 1:] = wanted[:, 1:] != wanted[:, :-1]
    running = [int(np.searchsorted(-count, -t)) for t in range(count[0])]  # lines with more than t frames

    on = np.full((n, wide), -np.inf, np.float32)
    between = np.full((n, wide + 1), -np.inf, np.float32)
    between[:, 0], on[:, 0] = scores[0, :, 0], scores[0, :, 1]
    entered = np.zeros((count[0], n, wide), np.uint8)  # 0 stayed, 1 from the blank before, 2 from the target before
    closed = np.zeros((count[0], n, wide + 1), bool)  # the blank follows its target at once
    for t in range(1, count[0]):
        m = running[t]
        last, quiet = on[:m], between[:m]
        from_target = np.full((m, wide), -np.inf, np.float32)
        from_target[:, 1:] = np.where(adjacent[:m, 1:], last[:, :-1], -np.inf)
        best = np.maximum(last, quiet[:, :-1])
        entered[t, :m] = quiet[:, :-1] > last
        entered[t, :m][from_target > best] = 2
        closed[t, :m, 1:] = last > quiet[:, 1:]
        quiet[:, 1:] = np.maximum(quiet[:, 1:], last)
        quiet += scores[t, :m, :1]
        on[:m] = np.maximum(best, from_target) + scores[t, :m, 1:]

    line = np.arange(n)
    silent = between[line, ends] >= on[line, ends - 1]
    at = np.where(silent, ends, ends - 1)
    labels = np.empty((count[0], n), np.int32)
    for t in range(count[0] - 1, -1, -1):
        m = running[t]
        rows, here, quiet = line[:m], at[:m], silent[:m]
        target = np.where(quiet, 0, here)
        labels[t, :m] = np.where(quiet, blank, wanted[rows, target])
        how = entered[t, rows, target]
        leaves = quiet & closed[t, rows, np.where(quiet, here, 0)]
        at[:m] = here - (leaves | (~quiet & (how == 2)))
        silent[:m] = np.where(quiet, ~leaves, how == 1)
    for i, place in enumerate(places):
        out[place] = labels[:count[i], i]
