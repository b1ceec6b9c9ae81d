"""Cleaning, splitting and measuring text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import WS_CHARS, chars, col, collapse, let, strip, word_count
from .pointwise import END, GONE, Rule, every_other, letters, present, rewrite

# What the cleaner removes. Zero-width characters vanish;
# typeset punctuation and ASCII letters and digits become a space.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
PUNCTUATION = ",.;:?!-\u2013\u2014[]()`\"'\u2018\u2019\u201c\u201d\u00a0\u02bb\u02bc"
DANDA, DOUBLE_DANDA = "।", "॥"

# Limits of the corpus build.
MAX_LINE_CHARS = 700
RATIO_LOW, RATIO_HIGH = 0.7, 1.5
MIN_WORDS, MAX_WORDS = 4, 35

# What a labeller's reply may keep, besides the Kannada block.
THINK_BLOCK = r"(?s)<think>.*?</think>"
NOT_KANNADA = "[^\u0c80-\u0cff\u200d\u200c\u0964\u0965 ]"
UNREADABLE = "UNREADABLE"
NUMBERED_LINE = r"(?U)^[\s\x1c-\x1f]*(\d+)[\s\x1c-\x1f]*[:.)][\s\x1c-\x1f]*(.*)$"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

SENTENCE_END = "[" + DANDA + DOUBLE_DANDA + r".!?\n]|\|\|?"

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_TYPESET = ({c: " " for c in _LATIN + _LATIN.upper() + "0123456789" + PUNCTUATION + WS_CHARS}
            | {c: "" for c in ZERO_WIDTH} | {"|": DANDA})


def cleaning() -> Rule:
    """Bars to dandas, zero-width characters out, typeset marks to spaces; one space at a time, none at the ends."""
    letter_of = letters(_TYPESET)

    def cleaned(points: np.ndarray) -> np.ndarray:
        letter = letter_of.take(points, mode="clip")
        bars = points == ord("|")
        double = every_other(np.flatnonzero(bars[:-1] & bars[1:]))
        letter[double], letter[double + 1] = ord(DOUBLE_DANDA), GONE
        letter = present(letter)
        # Of neighbouring spaces the last stays, and none beside an END.
        spaces = np.flatnonzero(letter == ord(" "))
        after = letter[spaces + 1]
        letter[spaces.compress((after == ord(" ")) | (after == END))] = GONE
        letter = present(letter)
        spaces = np.flatnonzero(letter == ord(" "))
        first = spaces.compress(letter[spaces - 1] == END)  # the last of all is END
        letter[first] = GONE
        return present(letter) if len(first) else letter

    return cleaned


@F.arrow_udf(T.StringType())
def _clean_manuscript(texts: pa.Array) -> pa.Array:
    return rewrite(texts, cleaning())


def clean_manuscript(text: Column | str) -> Column:
    """Bars to dandas, zero-width characters out, typeset marks to spaces."""
    return _clean_manuscript(col(text))


def single_line(text: Column | str) -> Column:
    """Strip, then newlines and tabs to spaces."""
    return F.translate(strip(text), "\n\t", "  ")


def clean_modern(text: Column | str) -> Column:
    """Whitespace tidied, punctuation kept."""
    return collapse(text)


def shortest_reading(readings: Column | str) -> Column:
    """The map value with the fewest words; the earlier key wins ties."""
    ranked = F.transform(
        F.map_values(col(readings)),
        lambda v, i: F.struct(word_count(v).alias("n"), i.alias("i"), v.alias("v")),
    )
    return F.array_min(ranked)["v"]


def clean_reply(raw: Column | str) -> Column:
    """A labeller's reply reduced to Kannada script; UNREADABLE becomes ''."""
    answer = F.regexp_replace(col(raw), THINK_BLOCK, "")
    return F.when(strip(answer) == UNREADABLE, F.lit("")).otherwise(
        collapse(F.regexp_replace(answer, NOT_KANNADA, " "))
    )


def parse_numbered_reply(raw: Column | str, n: Column | int) -> Column:
    """Texts 1..n of a numbered reply, or NULL unless each number occurs once."""
    n = F.lit(n) if isinstance(n, int) else n
    lines = F.split(F.regexp_replace(col(raw), THINK_BLOCK, ""), LINE_BREAK)
    kannada_digits = "".join(chr(0x0CE6 + d) for d in range(10))
    found = F.transform(
        F.filter(lines, lambda s: s.rlike(NUMBERED_LINE)),
        lambda s: F.struct(
            F.translate(F.regexp_extract(s, NUMBERED_LINE, 1), kannada_digits, "0123456789")
            .try_cast("bigint").alias("n"),
            F.regexp_extract(s, NUMBERED_LINE, 2).alias("text"),
        ),
    )
    wanted = F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint"))
    return let(
        F.sort_array(found),
        lambda got: F.when((n >= 1) & (got["n"] == wanted), got["text"]),
    )


def sentences(text: Column | str) -> Column:
    """Stripped non-empty pieces between sentence ends."""
    return F.filter(F.transform(F.split(col(text), SENTENCE_END), strip), lambda s: s != "")


def sentence_ok(sentence: Column | str, low: int = MIN_WORDS, high: int = MAX_WORDS) -> Column:
    return word_count(sentence).between(low, high)


def length_ratio(old: Column | str, new: Column | str) -> Column:
    """len(new)/len(old); NULL for an empty old side."""
    return F.when(F.char_length(col(old)) > 0, F.char_length(col(new)) / F.char_length(col(old)))


def in_band(old: Column | str, new: Column | str, low: float = RATIO_LOW, high: float = RATIO_HIGH) -> Column:
    return F.coalesce(length_ratio(old, new).between(low, high), F.lit(False))


def usable_length(text: Column | str, cap: int = MAX_LINE_CHARS) -> Column:
    return F.char_length(col(text)).between(1, cap)


def file_stem(path: Column | str) -> Column:
    name = F.regexp_extract(col(path), r"[^/]*$", 0)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def page_stem(path: Column | str) -> Column:
    """File stem without a trailing copy mark such as (1)."""
    return F.regexp_replace(file_stem(path), r"\(\d+\)$", "")


def page_group(page: Column | str) -> Column:
    return F.split(col(page), r"\.")[0]


def page_id(path: Column | str, hd_mark: str = "hd_images") -> Column:
    path = col(path)
    return F.concat(page_stem(path), F.when(path.contains(hd_mark), F.lit("_hd")).otherwise(F.lit("")))


def quality_bucket(sharpness: Column | str, contrast: Column | str, brightness: Column | str) -> Column:
    """broken / acceptable / good from three numbers; unreadable is broken."""
    s, c, b = col(sharpness), col(contrast), col(brightness)
    return (
        F.when(c.isNull() | (c < 12) | (b < 15) | (b > 240), F.lit("broken"))
        .when((s < 40) | (c < 25), F.lit("acceptable"))
        .otherwise(F.lit("good"))
    )


def is_line_strip(width: Column | str, height: Column | str, aspect: float = 6.0) -> Column:
    return col(width) / F.greatest(col(height), F.lit(1)) >= aspect


def scaled_width(width: Column | str, height: Column | str, line_height: int = 64, step: int = 8) -> Column:
    """Width after scaling to the line height, rounding halves to even."""
    scaled = F.bround(col(width) * F.lit(float(line_height)) / col(height), 0).cast("bigint")
    return F.greatest(F.lit(step).cast("bigint"), scaled)


def frame_count(width: Column | str, step: int = 8, at_least_one: bool = False) -> Column:
    frames = F.floor(col(width) / step)
    return F.greatest(F.lit(1).cast("bigint"), frames) if at_least_one else frames


def count_of(text: Column | str, piece: str) -> Column:
    text = col(text)
    gone = F.char_length(text) - F.char_length(F.replace(text, F.lit(piece), F.lit("")))
    return (gone / len(piece)).cast("int")


def replace_char(text: Column | str, old: str, new: str) -> Column:
    return F.replace(col(text), F.lit(old), F.lit(new))


def missing_chars(text: Column | str, allowed: Column) -> Column:
    """Sorted distinct characters of a text that a target set lacks."""
    return F.sort_array(F.array_except(F.array_distinct(chars(text)), allowed))


def repetition_rate(tokens: Column) -> Column:
    """Share of the tokens in a line that repeat an earlier one."""
    return F.when(F.size(tokens) > 0, 1 - F.size(F.array_distinct(tokens)) / F.size(tokens))


