"""Explicit schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

VERSES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("verse", T.StringType()),
    T.StructField("interpretations", T.MapType(T.StringType(), T.StringType())),
])

LINES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("verse_id", T.LongType()),
    T.StructField("is_test", T.BooleanType()),
    T.StructField("text", T.StringType()),
    T.StructField("modern_text", T.StringType()),
    T.StructField("argmax_indices", T.ArrayType(T.IntegerType())),
    T.StructField("argmax_wx", T.StringType()),
    T.StructField("n_frames", T.IntegerType()),
])

FRAMES = T.StructType([
    T.StructField("line_id", T.LongType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("log_probs", T.ArrayType(T.DoubleType())),
])

LABELS = T.StructType([
    T.StructField("crop", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("raw", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("error", T.StringType()),
])

CROPS = T.StructType([
    T.StructField("page", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("line_index", T.IntegerType()),
    T.StructField("crop", T.StringType()),
    T.StructField("crop_bbox", T.ArrayType(T.IntegerType())),
    T.StructField("box", T.ArrayType(T.IntegerType())),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("mask_area", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("centroid_x", T.DoubleType()),
    T.StructField("centroid_y", T.DoubleType()),
])

GOLD = T.StructType([
    T.StructField("crop", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("illegible", T.BooleanType()),
    T.StructField("source", T.StringType()),
])

PHOTOS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("sharpness", T.DoubleType()),
    T.StructField("contrast", T.DoubleType()),
    T.StructField("brightness", T.DoubleType()),
    T.StructField("heuristic_bucket", T.StringType()),
    T.StructField("human_verdict", T.StringType()),
    T.StructField("notes", T.StringType()),
])

PAGE_SURVEY = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("n_instances", T.IntegerType()),
    T.StructField("class_counts", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("error", T.StringType()),
])

SPLIT_LEDGER = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("timestamp_utc", T.TimestampType()),
    T.StructField("method", T.StringType()),
    T.StructField("n_candidates", T.LongType()),
    T.StructField("n_test", T.LongType()),
    T.StructField("note", T.StringType()),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("config", T.StringType()),
    T.StructField("results", T.StringType()),
])
