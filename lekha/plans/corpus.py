"""The corpus builds: old lines, old/modern pairs, and rule-made pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec, spelling, text
from ..functions.expr import once


def _old_side(c: str):
    return text.clean_manuscript(text.single_line(c))


def old_lines(verses: DataFrame) -> DataFrame:
    """(id, text): cleaned verses of usable length that survive the codec."""
    cleaned = once(verses, ["id"], text=_old_side("verse"))
    return cleaned.where(text.usable_length("text") & codec.round_trips("text"))


def verse_pairs(verses: DataFrame) -> DataFrame:
    """(verse_id, old_text, modern_text): the shortest interpretation as modern side."""
    given = verses.where(F.size("interpretations") > 0).withColumnRenamed("id", "verse_id")
    old = once(given, ["verse_id", "interpretations"], old_text=_old_side("verse"))
    usable = old.where(text.usable_length("old_text") & codec.round_trips("old_text"))
    # Most verses are too long; only the others' readings are counted and cleaned.
    both = once(usable, ["verse_id", "old_text"], modern_text=text.clean_modern(text.shortest_reading("interpretations")))
    return both.where("modern_text <> ''")


def rule_pairs(verses: DataFrame, rate: float = spelling.SWAP_RATE, seed: int = 0) -> DataFrame:
    """(old_text, modern_text) from every distinct interpretation sentence."""
    raw = verses.select(F.explode(F.map_values("interpretations")).alias("t"))
    pieces = raw.select(F.explode(text.sentences("t")).alias("s")).where(text.sentence_ok("s")).distinct()
    cleaned = once(pieces, ["s"], c=text.clean_manuscript("s")).where("c <> ''")
    old = once(cleaned, ["s"], old_text=spelling.old_style("c", "s", rate, seed))
    return old.where(codec.round_trips("old_text")).select("old_text", text.clean_modern("s").alias("modern_text"))


def corpus_funnel(verses: DataFrame) -> DataFrame:
    """Verses by their fate on the way to the old-line corpus."""
    cleaned = once(verses, [], t=_old_side("verse"))
    size = F.char_length("t")
    fate = (
        F.when(size == 0, "empty").when(size > text.MAX_LINE_CHARS, "too_long")
        .when(~codec.encodable("t"), "unencodable").when(~codec.round_trips("t"), "ambiguous").otherwise("kept")
    )
    return cleaned.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))
