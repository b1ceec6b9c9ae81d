"""Typed romanisation to Kannada script, as one rule over code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import col
from .pointwise import Rule, behind, every_other, joined, kinds, letters, rewrite
from .text import cleaning

# ---- Fixed values: the typing scheme (they must equal the published scheme)
CONSONANTS = {
    "k": "ಕ", "kh": "ಖ", "g": "ಗ", "gh": "ಘ", "~N": "ಙ",
    "ch": "ಚ", "Ch": "ಛ", "chh": "ಛ", "j": "ಜ", "jh": "ಝ", "~n": "ಞ",
    "T": "ಟ", "Th": "ಠ", "D": "ಡ", "Dh": "ಢ", "N": "ಣ",
    "t": "ತ", "th": "ಥ", "d": "ದ", "dh": "ಧ", "n": "ನ",
    "p": "ಪ", "ph": "ಫ", "f": "ಫ", "b": "ಬ", "bh": "ಭ", "m": "ಮ",
    "y": "ಯ", "r": "ರ", "rY": "ಱ", "l": "ಲ", "L": "ಳ", "lY": "ೞ",
    "v": "ವ", "w": "ವ", "sh": "ಶ", "Sh": "ಷ", "S": "ಷ", "s": "ಸ", "h": "ಹ",
}
VOWELS = {
    "a": "ಅ", "aa": "ಆ", "A": "ಆ", "i": "ಇ", "ii": "ಈ", "I": "ಈ",
    "u": "ಉ", "uu": "ಊ", "U": "ಊ", "R": "ಋ", "e": "ಎ", "ee": "ಏ", "E": "ಏ",
    "ai": "ಐ", "o": "ಒ", "oo": "ಓ", "O": "ಓ", "au": "ಔ",
}
MATRA_OF = {
    "ಅ": "", "ಆ": "ಾ", "ಇ": "ಿ", "ಈ": "ೀ", "ಉ": "ು", "ಊ": "ೂ", "ಋ": "ೃ",
    "ಎ": "ೆ", "ಏ": "ೇ", "ಐ": "ೈ", "ಒ": "ೊ", "ಓ": "ೋ", "ಔ": "ೌ",
}
SIGNS = {"M": "ಂ", "H": "ಃ"}
DIGITS = {str(d): chr(0x0CE6 + d) for d in range(10)}
BARE_MARK = "q"
VIRAMA = "್"
# ---- end of fixed values

# The scheme as one code for each long key, in the order in which keys are tried.
_CONSONANT_CODE = {c: chr(0xE100 + i) for i, c in enumerate(dict.fromkeys(CONSONANTS.values()))}
_VOWEL_CODE = {"ಅ": "a", "ಆ": "A", "ಇ": "i", "ಈ": "I", "ಉ": "u", "ಊ": "U", "ಋ": "R", "ಎ": "e", "ಏ": "E",
               "ಐ": "\x05", "ಒ": "o", "ಓ": "O", "ಔ": "\x06"}

_LONG_CONSONANTS = sorted((k for k in CONSONANTS if len(k) > 1), key=len, reverse=True)
_LONG_VOWELS = [k for k in VOWELS if len(k) > 1]
_CONS = [*(k for k in CONSONANTS if len(k) == 1), *_CONSONANT_CODE.values()]
_FINAL = ({k: v for k, v in CONSONANTS.items() if len(k) == 1} | {code: c for c, code in _CONSONANT_CODE.items()}
          | {code: v for v, code in _VOWEL_CODE.items()} | SIGNS | DIGITS | {"|": "।"})


_CONSONANT, _VOWEL, _SIGN, _MARK = 1, 2, 3, 4  # kinds of characters, 0 for all others
_KIND = 24  # bits below a kind
_ROOM = 129  # ASCII, and one number for every other character


def typing() -> Rule:
    """Longest keys first from left to right; a vowel behind a typed consonant is its sign, a consonant without one has the virama."""
    # A letter's kind stands above its code point.
    letter_of, matra_of = letters({k: v for k, v in _FINAL.items() if k.isascii() and k.isprintable()}), letters(MATRA_OF)
    letter_of |= kinds([k for k in CONSONANTS if len(k) == 1], [k for k in VOWELS if len(k) == 1], filter(None, MATRA_OF.values()),
                       BARE_MARK).astype(np.uint32) << _KIND
    pair_letter, pair_kind = np.zeros(_ROOM ** 2, np.uint32), np.zeros(_ROOM ** 2, np.uint8)
    for k, v in [*CONSONANTS.items(), *VOWELS.items(), ("||", "॥")]:
        if len(k) == 2:
            place, kind = ord(k[0]) * _ROOM + ord(k[1]), _CONSONANT if k in CONSONANTS else _VOWEL if k in VOWELS else 0
            pair_letter[place], pair_kind[place] = ord(v) | kind << _KIND, 1 if k in CONSONANTS else 2
    triples = [(ord(k[0]) * _ROOM + ord(k[1]), ord(k[2]), ord(v) | _CONSONANT << _KIND)
               for k, v in CONSONANTS.items() if len(k) == 3]

    def typed(points: np.ndarray) -> np.ndarray:
        letter = letter_of.take(points, mode="clip")
        small = np.minimum(points, _ROOM - 1).astype(np.uint16)
        two = small[:-1] * np.uint16(_ROOM) + small[1:]
        pairs = pair_kind.take(two, mode="clip")
        at = np.flatnonzero(pairs)
        # No consonant key starts with a letter that ends another: they never overlap. Vowels and bars do ("aii").
        pairs = pairs[at]
        at = np.concatenate([at.compress(pairs == 1), every_other(at.compress(pairs == 2))])
        two = two[at]
        letter[at] = pair_letter[two]
        first = np.ones(len(points), bool)  # not a later character of a key
        first[at + 1] = False
        for start, end, consonant in triples:
            three = at.compress(two == start)
            three = three.compress(points[three + 2] == end)
            letter[three], first[three + 2] = consonant, False
        letter = letter.compress(first)
        kind = (letter >> _KIND).astype(np.uint8)
        letter &= (1 << _KIND) - 1
        vowels = np.flatnonzero(behind(kind, _VOWEL))
        letter[vowels] = matra_of[letter[vowels]]
        letter[behind(kind, _MARK)] = ord(VIRAMA)
        return joined(letter, kind, VIRAMA)

    return typed


@F.arrow_udf(T.StringType())
def _to_kannada(texts: pa.Array) -> pa.Array:
    return rewrite(texts, typing())


def to_kannada(text: Column | str) -> Column:
    return _to_kannada(col(text))


@F.arrow_udf(T.StringType())
def _to_clean_kannada(texts: pa.Array) -> pa.Array:
    return rewrite(texts, typing(), cleaning())


def to_clean_kannada(text: Column | str) -> Column:
    """`clean_manuscript` of `to_kannada`, both rules over the same pieces."""
    return _to_clean_kannada(col(text))
