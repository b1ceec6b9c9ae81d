"""Mixing sources to target weights.

Every source's words, in a hashed order of its documents, form one stream cut
into blocks of fixed length. Slots of the output shards draw their source from
a multinomial distribution; a surplus over a source's quota goes to sources
that came short, so a source gets its quota exactly. The j-th slot of a source
reads block ``permutation(j)``: a swap-or-not shuffle that is a bijection for
any number of blocks, computed per row. Slots and blocks meet by index.

Only DataFrame functions are used. Offsets are summed over hash buckets, so a
source with a third of all rows is spread over many tasks. The driver sees
one row per source.

Cases: a null or wordless text has size 0 and is never taken; a null source
is a source of its own and comes last; rows that repeat are documents of
their own; an empty table gives an empty mix. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import let
from ..session import stored
from .common import n_words, with_text

ROUNDS = 12
BUCKET_ROWS = 4000
KEY = ["doc_id", "source", "text_hash", "copy"]


@dataclass
class Mix:
    """``rows``: thin documents with their place in the source's stream;
    ``sources``: sizes, targets and quotas; ``slots``: what each output slot reads."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def _keyed(docs: DataFrame) -> DataFrame:
    """Repeated rows are told apart by a copy number."""
    same = W.partitionBy("doc_id", "source", "text_hash").orderBy("doc_id")
    return docs.withColumn("copy", F.row_number().over(same))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Sources(source, source_size) with a number ``s`` from 1, weight and target.

    Sources share ``share`` times all words by weight; none gets more than
    ``most`` times its own size. Ordered by the ratio of cap to weight, the
    capped sources come first, so the common level is the largest of the
    levels that arise when the first k sources are capped. One row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = W.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("s", F.row_number().over(by_name)).withColumn(
        "weight", F.get(cycle, (F.col("s") - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "s")
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - capped) / open_weight)
    s = s.withColumn("level", F.max("level").over(whole))
    return s.withColumn("target", F.least("cap", F.col("weight") * F.col("level"))).drop("cap", "level")


def permuted(x: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom bijection of 0..size-1, different for each key."""
    def step(value: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), size) - value + size, size)
        coin = F.xxhash64(F.greatest(value, other), r, *key).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(value)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), step)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2,
        block: int = 64, shard_slots: int = 4096, seed: int = 0) -> Mix:
    """Plan a mix of ``docs(doc_id, source, text)``; no text is moved."""
    spark = docs.sparkSession
    thin = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), n_words("text").alias("size"))
    thin = stored(thin, "sizes")
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, most).withColumn("blocks", F.ceil(F.col("source_size") / block))
    sources = stored(sources.withColumn("quota", F.when(F.col("blocks") == 0, F.lit(0)).otherwise(F.least(
        F.round(F.col("target") * F.col("blocks") / F.col("source_size")), most * F.col("blocks"))).cast("long")), "sources")

    buckets = thin.count() // BUCKET_ROWS + 1
    placed = (_keyed(thin).join(sources.select(F.col("source").alias("name"), "s"), F.col("source").eqNullSafe(F.col("name")))
              .drop("name").withColumn("h", F.xxhash64(F.lit(seed), *KEY)).withColumn("bucket", F.pmod("h", F.lit(buckets))))
    sums = placed.groupBy("s", "bucket").agg(F.sum("size").alias("total"))
    before = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("s", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inner = W.partitionBy("s", "bucket").orderBy("h", *KEY).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.join(sums, ["s", "bucket"]).withColumn(
        "start", F.col("offset") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = stored(placed.select(*KEY, "s", "size", "start"), "streams")

    quotas = sources.where("quota > 0").orderBy("s").select("s", "quota").collect()  # one row per source
    total = sum(r["quota"] for r in quotas)
    slots = _slots(spark, sources, quotas, total, shard_slots, seed)
    slots = slots.join(sources.select("s", "blocks"), "s")
    epoch = F.floor(F.col("j") / F.col("blocks"))
    slots = slots.select("shard", "slot", "s", epoch.alias("epoch"), permuted(
        F.col("j") - epoch * F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("s"), epoch).alias("block"))
    return Mix(rows, sources, slots, block)


def _slots(spark, sources: DataFrame, quotas: list, total: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, s, j): the source of every output slot and its number within that source."""
    ids, bounds, summed = [], [], 0
    for r in quotas:
        summed += r["quota"]
        ids.append(F.lit(r["s"]))
        bounds.append(F.lit(summed / total))
    if not ids:
        return spark.range(0).selectExpr("id as shard", "id as slot", "cast(id as int) as s", "id as j")
    uniform = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    pick = F.size(F.filter(F.array(*bounds[:-1], F.lit(2.0)), lambda b: b <= F.col("u")))
    drawn = spark.range(total).withColumn("u", uniform).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), (F.col("id") % shard_slots).alias("slot"),
        F.get(F.array(*ids), pick).alias("s"))
    drawn = stored(drawn, "draws")
    counts = drawn.groupBy("s", "shard").agg(F.count("*").alias("n"))
    before = W.partitionBy("s").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("s", "shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(W.partitionBy("s", "shard").orderBy("slot"))
    drawn = drawn.join(counts.drop("n"), ["s", "shard"]).withColumn("j", F.col("offset") + number - 1)
    # The multinomial counts differ a little from the quotas: hand the surplus to those short of theirs.
    gap = sources.where("quota > 0").select("s", "quota").join(counts.groupBy("s").agg(F.sum("n").alias("got")), "s", "left")
    gap = gap.withColumn("got", F.coalesce("got", F.lit(0)))
    earlier = W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    over, short = F.greatest(F.col("got") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("got"), F.lit(0))
    gap = gap.select("s", "quota", "got", F.coalesce(F.sum(over).over(earlier), F.lit(0)).alias("over_before"),
                     F.coalesce(F.sum(short).over(earlier), F.lit(0)).alias("short_before"))
    drawn = drawn.join(gap.select("s", "quota", "over_before"), "s")
    fits = drawn.where("j < quota").select("shard", "slot", "s", "j")
    surplus = drawn.where("j >= quota").select("shard", "slot", (F.col("over_before") + F.col("j") - F.col("quota")).alias("i"))
    missing = gap.where("got < quota").select("s", "got", "short_before", F.explode(F.sequence("got", F.col("quota") - 1)).alias("j"))
    missing = missing.select("s", "j", (F.col("short_before") + F.col("j") - F.col("got")).alias("i"))
    return fits.union(surplus.join(missing, "i").select("shard", "slot", "s", "j"))


def taken_pieces(m: Mix) -> DataFrame:
    """Per document row and block it lies in: the words of that block it owns and how often the mix reads them."""
    first, last = F.floor(F.col("start") / m.block), F.floor((F.col("start") + F.col("size") - 1) / m.block)
    pieces = m.rows.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest("start", F.col("block") * m.block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * m.block)
    pieces = pieces.select(*KEY, "s", "size", "start", "block", (begin - F.col("start")).alias("from"), (end - begin).alias("n"))
    uses = m.slots.groupBy("s", "block").agg(F.count("*").alias("uses"))
    return pieces.join(uses, ["s", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def taken_words(m: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per document row."""
    some = taken_pieces(m).groupBy("doc_id", "s", "size", "start").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    none = m.rows.where("size = 0").select("doc_id", "s", "size", "start", F.lit(0).cast("long").alias("taken"))
    return some.union(none).join(m.sources.select("s", "source", "source_size", "target"), "s").select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, m: Mix) -> DataFrame:
    """The documents of the mix with the words it takes, in their own order; second helpings follow the first.

    A text taken whole and once stays as it is. ``n_chars`` is counted anew where there is one.
    """
    chosen = taken_pieces(m).where("uses > 0").withColumn("round", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    plan = chosen.groupBy(*KEY, "size").agg(
        F.sum("n").alias("taken"), F.max("round").alias("rounds"),
        F.array_sort(F.collect_list(F.struct("round", "from", "n"))).alias("parts"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")  # other columns may bear any name
    keyed = _keyed(docs.select(row, "doc_id", "source", "text", F.xxhash64("text").alias("text_hash")))
    plan = plan.select(*[F.col(k).alias(f"k_{k}") for k in KEY], "size", "taken", "rounds", "parts")
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in KEY]
    joined = keyed.join(plan, same[0] & same[1] & same[2] & same[3])
    words = F.regexp_extract_all(F.concat("text", F.lit("\n")), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]+"), F.lit(0))
    cut = let(words, lambda w: F.array_join(F.transform(
        "parts", lambda p: F.array_join(F.slice(w, p["from"].cast("int") + 1, p["n"].cast("int")), "")), ""))
    text = F.when((F.col("rounds") == 1) & (F.col("taken") == F.col("size")), F.col("text")).otherwise(F.rtrim(cut, F.lit("\n")))
    return with_text(joined.withColumn("__text", text), docs)
