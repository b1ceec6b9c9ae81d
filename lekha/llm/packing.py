"""Packing documents into fixed windows by lexical retrieval.

Each shard (a block of neighbouring rows of one input split, about 12 MB of
text) holds a BM25 inverted index over the words of its documents. A document
that still has unpacked tokens seeds a window. All unused documents that share
a word with it are candidates, by BM25 score over all its words: the best ones
that fit whole are taken, and the best one left is cut where the window ends. Parts of 2048 tokens are windows of
their own. What is left at a shard's end is split at powers of two, so no
window needs padding. Nothing is shuffled, and a lost task is simply run again.

Cases: a null or empty text is its end token only; repeated rows are packed
each; ids come from the tokenizer file whose path is a parameter. Documents
that share no word with the seed follow in row order. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, split_words

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Words made of Latin letters and a tail of marks: the tokenizer parts them
# there, whatever stands around them. All other words go to it whole.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]*$"


class Words:
    """Token ids of words, each distinct core, tail or other word cut once while memory for it lasts."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.known: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= self.most:
                self.known.clear()
            # Visible ASCII characters are their own byte letters.
            spelt = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            ids = [t.id for t in self.tokenizer.model.tokenize(spelt)]
            self.known[piece] = ids
        return ids

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words behind one another, and how many each has."""
        core = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(core, LETTERS)
        tail = _rest(words, core)
        none = pa.scalar("")
        parts = [(pc.utf8_lower(pc.if_else(plain, core, none)), self._piece), (pc.if_else(plain, tail, none), self._piece),
                 (pc.if_else(plain, none, words), self._whole)]
        lists, each, index = [], [], []
        for texts, cut in parts:
            coded = texts.dictionary_encode()
            index.append(coded.indices.to_numpy().astype(np.int64) + len(each))
            own = [cut(w) if w else [] for w in coded.dictionary.to_pylist()]
            each += map(len, own)
            lists += own
        each = np.array(each, np.int64)
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(each.sum()))
        index = np.column_stack(index)
        return flat[_places(index.reshape(-1), np.cumsum(each) - each, each)], each[index].sum(axis=1)


def _rest(words: pa.Array, start: pa.Array) -> pa.Array:
    """What follows the start of each word."""
    words, start = words.cast(pa.large_string()), start.cast(pa.large_string())
    _, bounds, data = words.buffers()
    bounds = np.frombuffer(bounds, np.int64)[words.offset:words.offset + len(words) + 1]
    n = pc.binary_length(start).to_numpy()
    size = np.diff(bounds) - n
    at = np.repeat(bounds[:-1] + n - (np.cumsum(size) - size), size) + np.arange(size.sum())
    ends = np.concatenate([[0], np.cumsum(size)])
    rest = np.frombuffer(data, np.uint8)[at] if data is not None else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(rest)]).cast(pa.string())


def _places(index: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the items of the lists with these numbers stand, by where every list begins and its size."""
    n = sizes[index]
    return np.repeat(begin[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())


_WORDS: dict[str, Words] = {}


def tokenised(texts: pa.Array, path: str, end: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ids of each text with the end id; and the word numbers and word bounds they came from."""
    known = _WORDS.setdefault(path, None) or Words(path)
    _WORDS[path] = known
    words, starts = split_words(texts)
    flat, sizes = known.ids(words.dictionary)
    begin = np.cumsum(sizes) - sizes
    index = words.indices.to_numpy().astype(np.int64)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        out.append(np.append(flat[_places(index[a:b], begin, sizes)], np.uint32(end)))
    return out, index, starts


class Index:
    """BM25 postings of one shard, of every word that two of its documents share."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, k1: float = 1.2, b: float = 0.75):
        docs, n = len(starts) - 1, np.diff(starts)
        most = int(words.max()) + 1 if len(words) else 1
        pair, tf = np.unique(np.repeat(np.arange(docs), n) * most + words, return_counts=True)
        doc, term = pair // most, pair % most
        df = np.bincount(term, minlength=most)
        useful = df[term] > 1  # a word of one document finds nobody
        doc, term, tf = doc[useful], term[useful], tf[useful]
        idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[doc] / max(1.0, n.mean())))
        self.terms, self.doc_bounds = term, np.searchsorted(doc, np.arange(docs + 1))
        by_term = np.argsort(term, kind="stable")
        self.term, self.doc, self.weight = term[by_term], doc[by_term], weight[by_term]
        self.bounds, self.listed = self._bounds(most), docs

    def _bounds(self, most: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=most))])

    def _forget(self, unused: np.ndarray) -> None:
        """Drop the postings of packed documents, once an eighth of the listed documents is packed."""
        left = int(unused.sum())
        if left * 8 <= self.listed * 7:
            keep = unused[self.doc]
            self.term, self.doc, self.weight = self.term[keep], self.doc[keep], self.weight[keep]
            self.bounds, self.listed = self._bounds(len(self.bounds) - 1), left

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """BM25 score of every unused document for all words of the seed; 0 where they share none."""
        self._forget(unused)
        terms = self.terms[self.doc_bounds[seed]:self.doc_bounds[seed + 1]]
        if not len(terms):
            return np.zeros(len(unused))
        runs = [slice(i, j) for i, j in zip(self.bounds[terms], self.bounds[terms + 1])]
        doc = np.concatenate([self.doc[r] for r in runs])
        score = np.bincount(doc, np.concatenate([self.weight[r] for r in runs]), len(unused))
        score[~unused] = 0
        return score


def packed(sizes: np.ndarray, index: Index, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length)."""
    out = [[(d, k, window)] for d, n in enumerate(sizes) for k in range(0, int(n) - window + 1, window)]
    at = (sizes // window * window).astype(np.int64)
    unused = at < sizes
    first, rest = 0, []
    while True:
        while first < len(sizes) and not unused[first]:
            first += 1
        if first == len(sizes):
            break
        room, parts = window, []

        def take(d: int) -> None:
            nonlocal room
            n = min(room, int(sizes[d] - at[d]))
            parts.append((int(d), int(at[d]), n))
            at[d] += n
            room -= n
            unused[d] = at[d] < sizes[d]

        take(first)
        if room:
            score = index.scores(first, unused)
            near = np.flatnonzero(score)
            score, left = score[near], (sizes - at)[near]
            fits = np.flatnonzero(left <= room)  # room only shrinks: what does not fit now never will
            while len(fits):
                best = fits[np.argmax(score[fits])]
                take(near[best])
                score[best] = 0
                fits = fits[(left[fits] <= room) & (fits != best)]
            if room and score.any():
                take(near[np.argmax(score)])
        d = first
        while room and d < len(sizes):
            if unused[d]:
                take(d)
            d += 1
        (rest if room else out).append(parts)
    for parts in rest:  # the last window, cut at powers of two
        left = sum(n for _, _, n in parts)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            own = []
            while size:
                d, start, n = parts.pop(0)
                if n > size:
                    parts.insert(0, (d, start + size, n - size))
                    n = size
                own.append((d, start, n))
                size -= n
            out.append(own)
    return out


def _shards(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, words, starts = tokenised(part.column("text"), path, end)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                names, rows = part.column("doc_id").to_pylist(), []
                for parts in packed(sizes, Index(words, starts), window):
                    offset = 0
                    for d, start, n in parts:
                        crc = zlib.crc32(ids[d][start:start + n].astype("<u4").tobytes())
                        rows.append((names[d], start, n, crc, int(sizes[d]), sequence, offset))
                        offset += n
                    sequence += 1
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1) -> DataFrame:
    """The pieces of all sequences of ``docs(doc_id, text)``."""
    thin = docs.select(F.col("doc_id").cast("long"), "text")
    return thin.mapInArrow(_shards(tokenizer, window, end), SCHEMA)
