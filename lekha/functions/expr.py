"""Small column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as a Unicode-aware text tool sees it: the White_Space property
# plus the four ASCII separators U+001C..U+001F.
WS = r"[\s\x1c-\x1f]"
WS_RUN = rf"(?U){WS}+"
WORD = r"(?U)[^\s\x1c-\x1f]+"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column expression named inside an array lambda is evaluated again for
    every element; binding it to a lambda variable keeps such code linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chars(text: Column | str) -> Column:
    """Code points of a text; the empty text has none."""
    text = col(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(WS_CHARS))


def collapse(text: Column | str) -> Column:
    """Whitespace runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), WS_RUN, " "))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(WORD))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0))


def replace_all(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Apply literal replacements one after another, in the order given."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def char_class(letters: Iterable[str], negated: bool = False) -> str:
    """A regex class of exactly these characters, neighbours joined to ranges.

    Java tests every part of a class in turn, so fewer parts run faster.
    """
    runs: list[list[int]] = []
    for code in sorted({ord(c) for c in letters}):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    parts = [f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in runs]
    return ("[^" if negated else "[") + "".join(parts) + "]"


def once(df: DataFrame, keep: Sequence[str], **computed: Column) -> DataFrame:
    """Add columns that later filters cannot be pushed through.

    A filter on an ordinary derived column moves below the projection and
    repeats its expression there for every use; a generated column is
    evaluated once per row.
    """
    row = F.struct(*[value.alias(name) for name, value in computed.items()])
    return df.select(*keep, F.inline(F.array(row)))
