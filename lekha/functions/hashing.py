"""Deterministic draws: the same key gets the same draw on any partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

# The frozen split is the first digest byte below 38 of 256.
FROZEN_PREFIX = "s2"
FROZEN_THRESHOLD = 38


def digest(prefix: str, key: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{prefix}:"), col(key).cast("string")), 256)


def first_byte(prefix: str, key: Column | str) -> Column:
    return F.conv(F.substring(digest(prefix, key), 1, 2), 16, 10).cast("int")


def in_hash_split(key: Column | str, prefix: str = FROZEN_PREFIX, threshold: int = FROZEN_THRESHOLD) -> Column:
    return first_byte(prefix, key) < threshold


def fraction_threshold(fraction: float) -> int:
    return int(fraction * 256)


def draw(seed: int | str, *keys: Column | str) -> Column:
    """Hex digest that orders rows of a sample."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]), 256)


def draw_chunk(drawn: Column | str) -> Column:
    """First three hex digits: 4096 order-preserving, evenly filled chunks."""
    return F.conv(F.substring(col(drawn), 1, 3), 16, 10).cast("int")


def content_key(*parts: Column | str, length: int = 24, separator: str = "") -> Column:
    """Address of a cached result: a sha256 prefix of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(separator, *[col(p) for p in parts]), 256), 1, length)
