"""Choosing one row per key, and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_group, page_stem, sentence_ok, sentences
from .ranking import first_per_key

SIGNATURE = ("width", "height", "sharpness", "contrast", "brightness")


def distinct_sentences(df: DataFrame, text: str) -> DataFrame:
    """Distinct sentences of acceptable length. Sort on output if needed."""
    pieces = df.select(F.explode(sentences(text)).alias("sentence"))
    return pieces.where(sentence_ok("sentence")).distinct()


def first_per_signature(photos: DataFrame, position: str = "file_pos") -> DataFrame:
    """First readable photo of each signature."""
    return first_per_key(photos.where("width is not null"), SIGNATURE, [position])


def one_per_page(photos: DataFrame, path: str = "path", position: str = "file_pos",
                 hd_mark: str = "hd_images", is_hd: Column | None = None) -> DataFrame:
    """One row per page stem; a standard photo beats an hd one, else the first."""
    hd = F.col(path).contains(hd_mark) if is_hd is None else is_hd
    df = photos if "stem" in photos.columns else photos.withColumn("stem", page_stem(path))
    return first_per_key(df.withColumn("__hd", hd), ["stem"], ["__hd", position]).drop("__hd")


def first_per_image(df: DataFrame, position: str = "file_pos") -> DataFrame:
    keyed = df.withColumn("__key", F.coalesce("image", "crop"))
    return first_per_key(keyed, ["__key"], [position]).drop("__key")


def last_per_crop(df: DataFrame, position: str = "file_pos") -> DataFrame:
    return first_per_key(df, ["crop"], [F.desc(position)])


def tagged_union(**sources: DataFrame) -> DataFrame:
    """Union by name with a ``source_tag``; missing columns become NULL."""
    out = None
    for tag, df in sources.items():
        part = df.withColumn("source_tag", F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def id_set_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids only in a, only in b, in both: one aggregation, no set join."""
    tagged = a.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(F.col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = tagged.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"),
    )


def eligible_pages(photos: DataFrame, survey: DataFrame, stems: DataFrame, signatures: DataFrame,
                   line_class: str) -> DataFrame:
    """Surveyed pages with lines, without excluded stems or signatures, one per page.

    ``survey(path, file_pos, class_counts, error)``, ``photos(path, signature)``.
    """
    n_lines = F.coalesce(F.try_element_at("class_counts", F.lit(line_class)), F.lit(0))
    lines = survey.where("error is null").withColumn("n_lines", n_lines).where("n_lines >= 1")
    placed = lines.withColumn("stem", page_stem("path")).join(photos.select("path", *SIGNATURE), "path", "left")
    kept = placed.join(stems.select("stem"), "stem", "left_anti").join(
        signatures.select(*SIGNATURE), list(SIGNATURE), "left_anti")
    return one_per_page(kept).withColumn("group", page_group("stem"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged with the side."""
    ka, kb = a.select(*key).distinct(), b.select(*key).distinct()
    return ka.join(kb, list(key), "left_anti").withColumn("side", F.lit("left")).unionByName(
        kb.join(ka, list(key), "left_anti").withColumn("side", F.lit("right")))
