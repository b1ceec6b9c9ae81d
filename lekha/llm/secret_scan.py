"""Secret scan: known forms, and runs of characters of high entropy.

Three fixed patterns give the base spans. Candidate runs of token characters
are then read with a sliding window; its Shannon entropy per character class
is kept up to date by adding the new and dropping the old count. Windows over
the class's threshold that touch join into one ``entropy`` span. An allow-list
suppresses runs that only look random: words, numbers, paths and addresses,
identifiers in a fixed form, placeholders, ordered alphabets.

Cases: a null text is empty; offsets are code points, ends exclusive; texts
are read whole; repeated rows are scanned each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
# Bits a window of WINDOW characters must reach, by the run's narrowest class.
WINDOW = 20
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+\Z"), 3.0),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]+\Z"), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/=_-]+\Z"), 3.9),
)
ALLOWED = (
    re.compile(r"[A-Za-z_=/+-]+\Z"),  # no digit: words, rules, paths
    re.compile(r"[0-9_=/+-]+\Z"),  # no letter: numbers, dates
    re.compile(r"[A-Za-z]+[0-9]{0,4}\Z"),  # a word with a number behind it
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),  # a unique identifier
    re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[/_-](?:[A-Za-z]+|[0-9]+))+\Z"),  # words and numbers joined: paths, slugs
    re.compile(r"(?i).*(?:example|placeholder|changeme|xxxxx|abcdefgh|01234567|12345678)"),
)
STEP = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 2)]


def dense(run: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of the run whose windows reach their class's entropy."""
    if any(a.match(run) for a in ALLOWED):
        return []
    bits = next(b for _, form, b in CLASSES if form.match(run))
    most = window * (math.log2(window) - bits)  # the sum of n * log2(n) may not exceed this
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += STEP[n + 1] - STEP[n]
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += STEP[n - 1] - STEP[n]
        if i >= window - 1 and total <= most + 1e-9:
            if spans and spans[-1][1] >= i - window + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, ordered."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        found += [(m.start() + a, 3, m.start() + b) for a, b in dense(m[0])]
    return sorted(found)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            rows = []
            for text in part.column("text").to_pylist():
                spans = scan(text or "")
                base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3)
                n = [sum(1 for _, k, _ in spans if k == kind) for kind in range(4)]
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)))
            c = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c[i], pa.int64()) for i in range(4)], pa.array(c[4], pa.string()), pa.array(c[5], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])


def secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
