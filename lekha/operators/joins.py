"""Membership, lookup and integrity joins. Sides are broadcast only when
Spark finds them below its size threshold at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_members(df: DataFrame, key: str, members: DataFrame, name: str) -> DataFrame:
    """Boolean column: is the key in ``members(key)``?"""
    known = members.select(key).distinct().withColumn("__m", F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.coalesce("__m", F.lit(False))).drop("__m")


def only_members(df: DataFrame, key: Sequence[str], members: DataFrame) -> DataFrame:
    return df.join(members.select(*key), list(key), "left_semi")


def without_members(df: DataFrame, key: Sequence[str], members: DataFrame) -> DataFrame:
    return df.join(members.select(*key), list(key), "left_anti")


def exclude_pages(pages: DataFrame, stems: DataFrame, signatures: DataFrame,
                  signature: Sequence[str]) -> DataFrame:
    """Drop a page whose stem or whose signature is excluded. A signature
    with a NULL never excludes."""
    kept = pages.join(stems.select("stem"), "stem", "left_anti")
    return kept.join(signatures.select(*signature), list(signature), "left_anti")


def common_rows(key: str, *sets: DataFrame) -> DataFrame:
    """Inner join of several sets on one key."""
    out = sets[0]
    for other in sets[1:]:
        out = out.join(other, key)
    return out


def positional_join(a: DataFrame, b: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Join by explicit row number; unequal row counts fail the job."""
    counts = a.agg(F.count(F.lit(1)).alias("n")).withColumn(
        "m", b.agg(F.count(F.lit(1))).scalar())
    same = counts.select(
        F.when(F.col("n") == F.col("m"), F.lit(True)).otherwise(
            F.raise_error(F.lit("row counts differ")).cast("boolean"))
    )
    return a.where(same.scalar()).join(b, row_id)


def override_column(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Keep rows found in ``other`` and take the column from there."""
    taken = other.select(key, F.col(name).alias("__new"))
    return df.join(taken, key).withColumn(name, F.col("__new")).drop("__new")


BLOCK = 512  # members of a key that meet the members of another such block in one task


def in_blocks(df: DataFrame, key: str, member: str, size: int = BLOCK) -> DataFrame:
    """Adds ``block`` and the key's number of ``blocks``: its members dealt by hash, about ``size`` to a block."""
    blocks = df.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    return df.join(blocks, F.col(key) == F.col("__key")).drop("__key").withColumn(
        "block", F.pmod(F.xxhash64(member), F.col("blocks")))


def block_pairs(df: DataFrame, key: str, member: str, keep: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Every unordered pair of members of each key once: ``key``, then ``member`` and ``keep`` twice, suffixed _a and _b.

    Members are dealt to blocks and a task joins two blocks, so a key holding a
    third of all rows is spread over (blocks choose 2) tasks. ``member`` is
    unique within its key; _a is the smaller one. Null keys have no pairs.
    """
    dealt = in_blocks(df.select(key, member, *keep), key, member, size)
    columns = [member, *keep]

    def side(suffix: str, others: Column, low: Column, high: Column) -> DataFrame:
        return dealt.select("*", F.explode(others).alias("o")).select(
            key, low.alias("i"), high.alias("j"), *[F.col(c).alias(f"{c}_{suffix}") for c in columns])

    # The smaller block's members from one side, the larger block's from the other.
    own, other = F.col("block"), F.col("o")
    a = side("a", F.sequence(own, F.col("blocks") - 1), own, other)
    b = side("b", F.sequence(F.lit(0).cast("long"), own), other, own)
    swap = F.col(f"{member}_a") > F.col(f"{member}_b")
    met = a.join(b, [key, "i", "j"]).where(f"i < j or {member}_a < {member}_b")
    return met.select(key, *[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}")
                             for x, y in ("ab", "ba") for c in columns])


def self_pairs(df: DataFrame, key: str, order: str, value: str, both_ways: bool = False) -> DataFrame:
    """Pairs of different members of each key: i<j, or all i<>j."""
    pairs = block_pairs(df, key, order, [value]).select(
        key, F.col(f"{order}_a").alias("i"), F.col(f"{value}_a").alias("a"), F.col(f"{order}_b").alias("j"), F.col(f"{value}_b").alias("b"))
    if both_ways:
        pairs = pairs.unionAll(pairs.select(key, "j", "b", "i", "a"))
    return pairs.select(key, "i", "a", "j", "b")


def require_all(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row with the number missing; any missing key fails the job."""
    missing = wanted.select(key).distinct().join(found.select(key), key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n_missing")).withColumn(
        "n_missing", fail_unless(F.col("n_missing") == 0, F.col("n_missing"), "wanted keys are missing"))


def fail_unless(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("bigint"))


def set_report(key: str, **sets: DataFrame) -> DataFrame:
    """One row per set: rows, distinct keys, keys shared with a later set."""
    tagged = None
    for name, df in sets.items():
        part = df.select(F.col(key).alias("k"), F.lit(name).alias("set"))
        tagged = part if tagged is None else tagged.unionByName(part)
    per_key = tagged.groupBy("k").agg(*[
        F.count_if(F.col("set") == name).alias(name) for name in sets
    ])
    others = {name: sum((F.when(F.col(o) > 0, 1).otherwise(0) for o in sets if o != name), F.lit(0)) for name in sets}
    rows = per_key.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("set"), F.col(name).alias("n"), others[name].alias("shared")) for name in sets
    ])).alias("x")).select("x.*").where("n > 0")
    return rows.groupBy("set").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("shared") > 0).alias("n_shared"),
    )


def require_disjoint(key: str, **sets: DataFrame) -> DataFrame:
    """Fail unless every key is unique within and across the sets."""
    clean = (F.col("n_shared") == 0) & (F.col("n_rows") == F.col("n_keys"))
    return set_report(key, **sets).withColumn(
        "n_rows", fail_unless(clean, F.col("n_rows"), "sets overlap or repeat a key"))


def require_disjoint_values(rows: DataFrame, set_column: str, key: str) -> DataFrame:
    """``require_disjoint`` for the sets that a column's values name, null included.

    A null key equals no other: its rows count in ``n_rows`` only.
    """
    pairs = rows.groupBy(F.col(set_column).alias("set"), F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    shared = pairs.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    report = pairs.join(shared, "k", "left").groupBy("set").agg(
        F.sum("n").alias("n_rows"), F.count("k").alias("n_keys"), F.count("sets").alias("n_shared"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("keyed"))
    clean = (F.col("n_shared") == 0) & (F.col("keyed") == F.col("n_keys"))
    return report.select("set", fail_unless(clean, F.col("n_rows"), "sets overlap or repeat a key").alias("n_rows"), "n_keys", "n_shared")
