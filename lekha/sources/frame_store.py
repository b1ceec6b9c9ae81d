"""Checks on a frame table, and the content-addressed result cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import content_key


def frame_count_faults(frames: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines whose stored frames differ from ``lines(line_id, n_frames)``, or
    whose frame numbers are not 0..n-1."""
    stored = frames.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("stored"), F.min("frame").alias("low"), F.max("frame").alias("high"))
    both = lines.select("line_id", "n_frames").join(stored, "line_id", "full")
    sound = (F.col("stored") == F.col("n_frames")) & (F.col("low") == 0) & (F.col("high") == F.col("n_frames") - 1)
    return both.where(~F.coalesce(sound, F.lit(False)))


def width_faults(lines: DataFrame, pixels_per_frame: int = 8) -> DataFrame:
    """Lines whose announced frames are not ``width`` div ``pixels_per_frame`` (1 at least); a null width is a fault.

    ``lines(line_id, n_frames, width)`` is the manifest at ingest, before frames are read.
    """
    expected = F.greatest(F.floor(F.col("width") / pixels_per_frame), F.lit(1))
    return lines.where(~F.coalesce(F.col("n_frames") == expected, F.lit(False))).withColumn("expected", expected)


def frame_totals(frames: DataFrame, lines: DataFrame) -> DataFrame:
    """Frames stored, frames announced, lines with a fault."""
    faults = frame_count_faults(frames, lines).agg(F.count(F.lit(1))).scalar()
    announced = lines.agg(F.sum("n_frames")).scalar()
    return frames.agg(F.count(F.lit(1)).alias("stored")).withColumn(
        "announced", announced).withColumn("n_faults", faults)


def settings_json(settings: dict[str, Column]) -> Column:
    """Settings as JSON with sorted keys, in the spacing of common encoders."""
    parts = []
    for i, name in enumerate(sorted(settings)):
        parts += [F.lit((", " if i else "{") + f'"{name}": "'), settings[name].cast("string"), F.lit('"')]
    return F.concat(*parts, F.lit("}"))


def with_cache_key(df: DataFrame, parts: Sequence[Column], name: str = "cache_key", length: int = 24,
                   separator: str = "") -> DataFrame:
    return df.withColumn(name, content_key(*parts, length=length, separator=separator))


def cache_hits(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return requests.join(cache, key)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return requests.join(cache.select(key), key, "left_anti")


CACHE_BUCKETS = 256


def attach_cache(spark: SparkSession, path: str, schema: T.StructType, key: str = "cache_key", buckets: int = CACHE_BUCKETS) -> str:
    """The name of the table over the cache at ``path``, made where it is new to this session.

    The cache is kept in buckets of its key, sorted within them, so a lookup
    moves the requests to the buckets and leaves the cache where it is. The
    number of buckets belongs to the stored files: give the same each time.
    """
    name = "cache_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def add_to_cache(results: DataFrame, name: str, key: str = "cache_key", buckets: int = CACHE_BUCKETS) -> None:
    """Append results, one file per bucket that gets any."""
    columns = results.sparkSession.table(name).columns
    results.select(*columns).repartition(buckets, key).write.insertInto(name)


def look_up(requests: DataFrame, name: str, key: str = "cache_key", buckets: int = CACHE_BUCKETS, how: str = "inner") -> DataFrame:
    """Requests beside their cached results (``inner`` or ``left``), or those without one (``left_anti``)."""
    cache = requests.sparkSession.table(name)
    return requests.repartition(buckets, key).hint("shuffle_merge").join(cache, key, how)


_STREAM = 8 << 20


def _open(path: str):
    """A stream over a file of any store that Arrow knows; a path without a scheme is local."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + (rest or path).lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            digest = hashlib.sha256()
            with _open(path) as stream:
                while block := stream.read(_STREAM):
                    digest.update(block)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([digest.hexdigest()])], ["path", "length", "sha256"])


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file; a file of any size streams through its task in blocks.

    A digest runs through its file in order, so a task has whole files; files
    are dealt to tasks one by one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    dealt = files.repartition(F.col("path"))
    return dealt.mapInArrow(_digests, "path string, length long, sha256 string")
