"""Near-duplicate documents by one-permutation MinHash.

One hash per shingle; its leading bits choose a bin and the smallest hash of
each bin is the signature. An empty bin borrows from the first full bin in
its own pseudorandom order of bins, the same for all documents (optimal
densification). Bands of the signature are bucket keys. A bucket links its
members to its smallest document only, and every link is confirmed on the
full shingle sets. Where a bucket's members still lie in different components,
they get further centres, as do finer buckets made of two and three bands. These
rounds join large groups with few pairs. What then still shares a bucket across
components is searched exactly: shingles are ordered from rare to frequent, and
two sets of the wanted similarity share one of their rarest fifth. Documents
under one template differ in just these, so they meet only where they are alike.

Cases: a null or wordless text has no shingles and is linked with nothing;
fewer words than a shingle make one shingle; equal sets form one class, and
only its smallest document takes part in the search. A null ``doc_id`` is
returned with a null component and kept. Rows that repeat a ``doc_id`` are
one document with several texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import components, mixed, pieces, split_words, word_hashes

BINS = 128
ROWS = 4  # bins in a band: 32 bands miss a pair of similarity 0.8 with probability 5e-8
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, starts = split_words(texts, lower=True)
    w = word_hashes(words)
    n = len(w)
    grams = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        grams += w[k:k + len(grams)] * ODD[k % 8] + np.uint64(k)
    grams = mixed(grams)
    sets = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= width:
            g = np.sort(grams[a:b - width + 1])
            sets.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            whole = np.uint64(b - a)
            for k in range(a, b):
                whole = mixed(np.array([whole * ODD[7] + w[k]]))[0]
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _probes() -> np.ndarray:
    """For every bin the order in which it asks the others, drawn from a hash; the same in all tasks."""
    with np.errstate(over="ignore"):
        draws = mixed(np.arange(BINS * BINS, dtype=np.uint64) * ODD[0] + ODD[1])
    return np.argsort(draws.reshape(BINS, BINS), axis=1, kind="stable")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values per non-empty set."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    edges = np.arange(BINS, dtype=np.uint64) << shift
    values = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        full[i] = at < np.append(at[1:], len(s))
        values[i] = s[np.minimum(at, len(s) - 1)]
    order = _probes()
    row, bin_ = np.nonzero(~full)
    for attempt in range(BINS):
        if not len(row):
            break
        source = order[bin_, attempt]
        hit = full[row, source]
        values[row[hit], bin_[hit]] = values[row[hit], source[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return values


def _bands(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                some = [i for i, s in enumerate(sets) if len(s)]
                with np.errstate(over="ignore"):
                    v = signatures([sets[i] for i in some]).reshape(len(some), BINS // ROWS, ROWS)
                    keys = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), v.shape[:2])
                    for k in range(ROWS):
                        keys = mixed(keys * ODD[2] + v[:, :, k])
                bands: list = [None] * len(sets)
                for j, i in enumerate(some):
                    bands[i] = keys[j].view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "shingles"])
    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stored(docs.mapInArrow(_bands(width), "doc_id long, n_shingles long, set_key binary, bands array<long>"),
                    "minhash")
    named = signed.where("set_key is not null and doc_id is not null")
    first = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
    classes = stored(first.select("set_key", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"),
                                  F.col("r.bands").alias("bands")), "classes")
    slots = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = slots.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1")
    buckets = stored(slots.join(shared.select("key", "centre"), "key").select("key", "rep", "n", "centre"), "buckets")

    sized = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"))
    star = buckets.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"), F.col("n").alias("n_b")).distinct()
    tested = stored(_similar_sizes(star.join(sized, "a"), percent), "star")
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, shingles array<long>")
    sets = stored(sets.withColumn("same", F.xxhash64("shingles")).dropDuplicates(["doc_id", "same"]).drop("same"), "sets")
    links = stored(_confirmed(tested, sets, percent), "links")
    # A doc_id with several texts ties their classes together.
    own = named.join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count("*").alias("rows")).where("rows > 1 and a <> z")
    ties = own.join(several.select("doc_id", "a"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    links = links.union(ties)
    found = components(links, "minhash")
    # Buckets that still hold several components get more centres, then finer buckets do.
    placed = buckets.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    torn = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    crowd = stored(classes.join(placed.join(torn, "key", "left_semi").select("rep").distinct(), "rep", "left_semi"), "crowd")
    for bands in (1, 2, 3):
        more = stored(_finer(crowd, found, tested, bands, percent), "finer")
        tested = tested.union(more)
        links = stored(links.union(_confirmed(more, sets, percent)), "links")
        found = components(links, "minhash")
    rest = stored(_remaining(buckets, found, tested, sets, percent), "rest")
    if rest.limit(1).count():
        found = components(links.union(_confirmed(rest, sets, percent)), "minhash")
    discard(docs.sparkSession, buckets, tested, sets, crowd, rest)
    out = (signed.join(classes.select("set_key", "rep"), "set_key", "left")
           .join(found.withColumnRenamed("node", "rep"), "rep", "left"))
    component = F.least("doc_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _similar_sizes(pairs: DataFrame, percent: int) -> DataFrame:
    """Sets whose sizes alone rule the similarity out are no candidates."""
    return pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    joined = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s")), "a")
              .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t")), "b"))
    common = joined.select("a", "b", (F.size("s") + F.size("t")).alias("total"),
                           F.size(F.array_intersect("s", "t")).alias("both"))
    return common.where(f"both > 0 and 100 * both >= {percent} * (total - both)").select("a", "b").distinct()


def _finer(crowd: DataFrame, found: DataFrame, tested: DataFrame, bands: int, percent: int) -> DataFrame:
    """Untested star edges of buckets made of one or more neighbouring bands, between components only.

    A bucket has four centres: its smallest and its largest document, and two drawn by hash.
    """
    width = BINS // ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.xxhash64(
        i, *[F.get("bands", ((i + k) % width).cast("int")) for k in range(bands)]))
    slots = (crowd.join(found.withColumnRenamed("node", "rep"), "rep", "left")
             .select("rep", "n", F.coalesce("component", "rep").alias("c"), F.explode(keys).alias("key")))
    own, drawn = F.struct("rep", "n", "c"), F.struct(F.xxhash64("key", "rep").alias("draw"), "rep", "n", "c")
    ends = slots.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(own).alias("first"), F.max(own).alias("last"),
                                    F.min(drawn).alias("low"), F.max(drawn).alias("high")).where("lo <> hi")
    drawn_own = [F.struct(F.col(f"{x}.rep").alias("rep"), F.col(f"{x}.n").alias("n"), F.col(f"{x}.c").alias("c")) for x in ("low", "high")]
    centres = ends.select("key", F.explode(F.array_distinct(F.array("first", "last", *drawn_own))).alias("first"))
    pairs = slots.join(centres, "key").where("c <> first.c").select(
        F.least("rep", "first.rep").alias("a"), F.greatest("rep", "first.rep").alias("b"),
        F.when(F.col("rep") < F.col("first.rep"), F.col("n")).otherwise(F.col("first.n")).alias("n_a"),
        F.when(F.col("rep") < F.col("first.rep"), F.col("first.n")).otherwise(F.col("n")).alias("n_b"))
    return _similar_sizes(pairs, percent).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")


CELLS = 1 << 20  # cells of the table that counts shingles roughly; it alone is collected and sent to all tasks
_CHUNK = 1 << 14


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of one task, in chunks of cells."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        counts += np.bincount(_cell(pc.list_flatten(batch.column("shingles")).to_numpy()), minlength=CELLS)
    chunks = counts.reshape(-1, _CHUNK)
    some = np.flatnonzero(chunks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([c.tobytes() for c in chunks[some]], pa.binary())], ["chunk", "counts"])


def _add_cells(key: tuple, part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in part.column("counts").to_pylist())
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _rarest(counts, percent: int):
    """One row per shingle of each set's rarest part; ``pos`` counts from 0 in the order from rare to frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("shingles")).to_numpy().astype(np.int64)
            values = pc.list_flatten(batch.column("shingles")).to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((values, counts.value[_cell(values)], row))
            pos = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
            kept = pos < np.repeat(size - -(-percent * size // 100) + 1, size)
            row, pos, values = row[kept], pos[kept], values[order][kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values), batch.column("rep").take(pa.array(row)), batch.column("c").take(pa.array(row)),
                 pa.array(size[row]), pa.array(pos, pa.int32())], ["token", "rep", "c", "n", "pos"])
    return run


def _remaining(buckets: DataFrame, found: DataFrame, tested: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Untested pairs of different components that may be similar, among all members of buckets that hold several components.

    Exact: the rarest n - ceil(percent n) + 1 shingles of two similar sets have
    one in common, and at the first such the rest of both must still be long
    enough. Any order of shingles does, so rough counts order them. Members of a
    shingle's largest component only meet others, never each other.
    """
    slots = (buckets.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
             .select("key", "rep", F.coalesce("component", "rep").alias("c")))
    torn = slots.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    left = slots.join(torn, "key", "left_semi").select("rep", "c").distinct()
    own = stored(sets.withColumnRenamed("doc_id", "rep").join(left, "rep"), "left")
    spark = own.sparkSession
    counted = (own.select("shingles").mapInArrow(_count_cells, "chunk int, counts binary")
               .groupBy("chunk").applyInArrow(_add_cells, "chunk int, counts binary").collect())  # CELLS numbers at any size
    counts = np.zeros((CELLS // _CHUNK, _CHUNK), np.int64)
    for r in counted:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    rare = stored(own.mapInArrow(_rarest(spark.sparkContext.broadcast(counts.reshape(-1)), percent),
                                 "token long, rep long, c long, n long, pos int"), "rare")
    discard(spark, own)
    held = rare.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(
        F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("held")).where("held > 1")
    shared = stored(rare.join(held.drop("held"), "token"), "shared")
    discard(spark, rare)
    other = shared.select("token", F.col("rep").alias("rep2"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    apart = F.expr("c <> c2 and (c2 = main or rep < rep2)")
    similar = F.expr(f"least(n - pos, n2 - pos2) * {100 + percent} >= {percent} * (n + n2)")
    pairs = shared.where("c <> main").join(other, "token").where(apart & similar).select(
        F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
    return pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
