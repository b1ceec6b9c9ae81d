"""Label ingestion from a folder that receives JSON files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest_inbox(spark: SparkSession, inbox: str, schema: T.StructType, key: list[str], out: str, checkpoint: str,
                 files_per_trigger: int = 100, event_time: str | None = None, horizon: str | None = None) -> StreamingQuery:
    """Every new file once, every key once, until the folder is drained.

    The keys that have been seen are the stream's own state, kept with its
    checkpoint: a batch reads its own files and the state of its keys, nothing
    that earlier batches wrote. Files are taken oldest first, and of equal keys
    the row of the earliest batch stays; of equal keys in one batch one row
    stays, any of them. A null key is a key like others. The sink's log makes a
    repeated batch replace itself.

    The state grows with the number of keys. With an ``event_time`` column and a
    ``horizon`` ("7 days"), a key is forgotten that long after its row's time.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(inbox)
    if event_time is None:
        fresh = rows.dropDuplicates(key)
    else:
        fresh = rows.withWatermark(event_time, horizon or "0 seconds").dropDuplicatesWithinWatermark(key)
    return (fresh.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
