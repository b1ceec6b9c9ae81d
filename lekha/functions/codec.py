"""Kannada script to phonemic symbols and back, as string expressions.

Inside the expressions each symbol is one private-use character, so a symbol
sequence is an ordinary string: encoding and decoding are rules over code
points, and edit distance over symbols is plain `levenshtein`. `encode`/`decode` show arrays of symbol names at the edges.
Text outside the alphabet gives NULL, so callers can count it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import char_class, col
from .pointwise import END, VOID, Rule, behind, joined, kinds, letters, rewrite

# ---- Fixed values: the symbol alphabet (they must equal the published scheme)
CONSONANTS = {
    "ಕ": "k", "ಖ": "K", "ಗ": "g", "ಘ": "G", "ಙ": "f",
    "ಚ": "c", "ಛ": "C", "ಜ": "j", "ಝ": "J", "ಞ": "F",
    "ಟ": "t", "ಠ": "T", "ಡ": "d", "ಢ": "D", "ಣ": "N",
    "ತ": "w", "ಥ": "W", "ದ": "x", "ಧ": "X", "ನ": "n",
    "ಪ": "p", "ಫ": "P", "ಬ": "b", "ಭ": "B", "ಮ": "m",
    "ಯ": "y", "ರ": "r", "ಲ": "l", "ವ": "v",
    "ಶ": "S", "ಷ": "R", "ಸ": "s", "ಹ": "h",
    "ಳ": "lY", "ಱ": "rY", "ೞ": "zY",
}
VOWELS = {
    "ಅ": "a", "ಆ": "A", "ಇ": "i", "ಈ": "I", "ಉ": "u", "ಊ": "U", "ಋ": "q",
    "ಎ": "e", "ಏ": "E", "ಐ": "Y", "ಒ": "o", "ಓ": "O", "ಔ": "V",
}
MATRAS = {
    "ಾ": "A", "ಿ": "i", "ೀ": "I", "ು": "u", "ೂ": "U", "ೃ": "q",
    "ೆ": "e", "ೇ": "E", "ೈ": "Y", "ೊ": "o", "ೋ": "O", "ೌ": "V",
}
SIGNS = {"ಂ": "M", "ಃ": "H", "ಁ": "z", "ಽ": "Z"}
PUNCTUATION = {" ": "sp", "।": "danda", "॥": "ddanda"}
DIGITS = {chr(0x0CE6 + d): f"#{d}" for d in range(10)}
VIRAMA = "್"
INHERENT_VOWEL = "a"
BLANK = "<blank>"
# ---- end of fixed values

_PRIVATE = 0xE000


@dataclass(frozen=True)
class Script:
    """The rules of one abugida; every function takes one as a parameter."""

    consonants: dict[str, str] = field(default_factory=lambda: CONSONANTS)
    vowels: dict[str, str] = field(default_factory=lambda: VOWELS)
    matras: dict[str, str] = field(default_factory=lambda: MATRAS)
    signs: dict[str, str] = field(default_factory=lambda: SIGNS)
    punctuation: dict[str, str] = field(default_factory=lambda: PUNCTUATION)
    digits: dict[str, str] = field(default_factory=lambda: DIGITS)
    virama: str = VIRAMA
    inherent: str = INHERENT_VOWEL

    @property
    def vocab(self) -> list[str]:
        """Base symbols in code-point order; class 0 is the blank."""
        groups = (self.consonants, self.vowels, self.signs, self.punctuation)
        return sorted({s for g in groups for s in g.values()})

    @property
    def extended_vocab(self) -> list[str]:
        """Base symbols keep their numbers; digit symbols follow."""
        return self.vocab + list(self.digits.values())

    def index(self, symbol: str) -> int:
        return self.extended_vocab.index(symbol) + 1

    def private(self, symbol: str) -> str:
        return chr(_PRIVATE + self.index(symbol))


KANNADA = Script()


def vocab_table(spark: SparkSession, script: Script = KANNADA, digits: bool = False) -> DataFrame:
    """(index, symbol), blank first: a table of fixed size."""
    names = [BLANK] + (script.extended_vocab if digits else script.vocab)
    schema = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("symbol", T.StringType())])
    return spark.createDataFrame(list(enumerate(names)), schema)


def encodable(text: Column | str, digits: bool = False, script: Script = KANNADA) -> Column:
    """Every character known, and dependent signs only after a consonant."""
    text = col(text)
    groups = [script.consonants, script.vowels, script.matras, script.signs, script.punctuation]
    if digits:
        groups.append(script.digits)
    known = [c for g in groups for c in g] + [script.virama]
    dependent = [script.virama, *script.matras]
    foreign = text.rlike(char_class(known, negated=True))
    stray = text.rlike(f"(?<!{char_class(script.consonants)}){char_class(dependent)}")
    return ~foreign & ~stray


def _encoding(digits: bool, script: Script) -> Rule:
    dependent = [script.virama, *script.matras]
    groups = [script.consonants, script.vowels, script.matras, script.signs, script.punctuation] + [script.digits] * digits
    others = [c for g in groups for c in g if c not in script.consonants and c not in script.matras]
    kind_of = kinds(script.consonants, dependent, others)
    kind_of[END] = 3
    symbol_of = letters({c: script.private(s) for g in groups for c, s in g.items()} | {script.virama: ""})

    def encoded(points: np.ndarray) -> np.ndarray:
        symbol, kind = symbol_of.take(points, mode="clip"), kind_of.take(points, mode="clip")
        # Unknown characters, and dependent signs that follow no consonant.
        symbol[(kind == 0) | (kind == 2) & ~behind(kind, 2)] = VOID
        kind[kind == 3] = 0
        return joined(symbol, kind, script.private(script.inherent))

    return encoded


def encode_packed(text: Column | str, digits: bool = False, script: Script = KANNADA) -> Column:
    """Symbol sequence with one private-use character per symbol."""

    @F.arrow_udf(T.StringType())
    def encoded(texts: pa.Array) -> pa.Array:
        return rewrite(texts, _encoding(digits, script))

    return encoded(col(text))


def _decoding(script: Script) -> Rule:
    tables = [script.digits, script.punctuation, script.signs, script.vowels, script.consonants]
    letter_of = letters({script.private(s): c for t in tables for c, s in reversed(t.items())})
    vowels = {script.private(s): m for m, s in script.matras.items()} | {script.private(script.inherent): ""}
    kind_of, matra_of = kinds([script.private(s) for s in script.consonants.values()], vowels), letters(vowels)

    def decoded(points: np.ndarray) -> np.ndarray:
        letter, kind = letter_of.take(points, mode="clip"), kind_of.take(points, mode="clip")
        signs = np.flatnonzero(behind(kind, 2))
        letter[signs] = matra_of[points[signs]]
        return joined(letter, kind, script.virama)

    return decoded


def decode_packed(packed: Column | str, script: Script = KANNADA) -> Column:
    """Inverse of `encode_packed` for any symbol order."""

    @F.arrow_udf(T.StringType())
    def decoded(texts: pa.Array) -> pa.Array:
        return rewrite(texts, _decoding(script))

    return decoded(col(packed))


def _classes(packed: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Where each packed string's classes start, and the classes of all."""
    packed = packed.cast(pa.string())
    size = pc.fill_null(pc.utf8_length(packed), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    null = np.append(pc.is_null(packed).to_numpy(zero_copy_only=False), False)
    together = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), pc.fill_null(packed, "")), "")
    classes = np.frombuffer(together[0].as_py().encode("utf-32-le"), np.int32) - np.int32(_PRIVATE)
    return pa.array(starts, pa.int32(), mask=null), pa.array(classes)


def unpack(packed: Column | str, script: Script = KANNADA) -> Column:
    """Packed string to an array of symbol names."""
    names = [BLANK, *script.extended_vocab]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def unpacked(texts: pa.Array) -> pa.Array:
        starts, classes = _classes(texts)
        return pa.ListArray.from_arrays(starts, pa.array(names).take(classes))

    return unpacked(col(packed))


def pack(symbols: Column | str, script: Script = KANNADA) -> Column:
    """Array of symbol names to a packed string; NULL if any is unknown."""
    symbols = col(symbols)
    names = F.array(*[F.lit(s) for s in script.extended_vocab])
    codes = F.array(*[F.lit(script.private(s)) for s in script.extended_vocab])
    coded = F.transform(symbols, lambda s: F.get(codes, F.array_position(names, s).cast("int") - 1))
    return F.when(~F.exists(symbols, lambda s: s.isNull() | (F.array_position(names, s) == 0)),
                  F.array_join(coded, ""))


def encode(text: Column | str, digits: bool = False, script: Script = KANNADA) -> Column:
    return unpack(encode_packed(text, digits, script), script)


def decode(symbols: Column | str, script: Script = KANNADA) -> Column:
    return decode_packed(pack(symbols, script), script)


def round_trips(text: Column | str, script: Script = KANNADA) -> Column:
    """Encodable, and no bare consonant followed by an independent vowel."""
    clash = col(text).rlike(script.virama + char_class(script.vowels))
    return encodable(text, script=script) & ~clash


def to_string(symbols: Column | str) -> Column:
    return F.array_join(col(symbols), "|")


def from_string(text: Column | str) -> Column:
    text = col(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\|"))


def indices(packed: Column | str) -> Column:
    """Packed string to class indices (blank is 0, symbols from 1)."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def numbered(texts: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(*_classes(texts))

    return numbered(col(packed))


def pack_indices(ids: Column | str, n_classes: int) -> Column:
    """Class indices to one private-use character each."""
    codes = F.array(*[F.lit(chr(_PRIVATE + i)) for i in range(n_classes)])
    return F.array_join(F.transform(col(ids), lambda i: F.get(codes, i)), "")
