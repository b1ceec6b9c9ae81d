"""What several training-data operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, stored

# A word is a run of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column | str) -> Column:
    """Words of a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_text(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, held in ``__row``, with the text in ``__text``; ``n_chars`` follows where the text changed."""
    out = []
    for f in docs.schema.fields:
        value = F.col("__row").getField(f.name)
        if f.name == "text":
            value = F.col("__text")
        elif f.name == "n_chars":
            same = F.col("__row.text").eqNullSafe(F.col("__text"))
            value = F.when(same, value).otherwise(F.char_length("__text").cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out)


def pieces(batch: pa.RecordBatch, column: str, most: int = 12 << 20):
    """Slices of a batch whose texts hold about ``most`` bytes (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts as a dictionary array, and where each text's words start.

    The second array has one entry more than there are texts. ``lower`` folds A-Z only.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(full).dictionary_encode(), before[offsets - offsets[0]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """A 64-bit hash for every word occurrence, hashed once per distinct word."""
    import xxhash

    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64,
                        len(words.dictionary))
    return known[words.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)


def components(edges: DataFrame, purpose: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges(a, b)``, for nodes that have an edge.

    Alternates joining every neighbour and jumping to the label's own label,
    so paths of length n need about log n rounds. Each round is written to the
    shared folder in place of the one before; the driver sees one count per round.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stored(both.distinct(), f"{purpose}-links")
    labels = stored(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{purpose}-labels")
    for _ in range(rounds):
        near = (links.join(labels.select(F.col("a").alias("b"), F.col("component").alias("c")), "b")
                .groupBy("a").agg(F.min("c").alias("c")))
        step = (labels.join(near, "a").select("a", F.col("component").alias("old"), F.least("component", "c").alias("new")))
        jump = labels.select(F.col("a").alias("new"), F.col("component").alias("further"))
        step = stored(step.join(jump, "new", "left").select(
            "a", "old", F.least("new", F.coalesce("further", "new")).alias("component")), f"{purpose}-labels")
        discard(spark, labels)
        labels = step.select("a", "component")
        if step.where("old <> component").limit(1).count() == 0:
            discard(spark, links)
            return labels.withColumnRenamed("a", "node")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
