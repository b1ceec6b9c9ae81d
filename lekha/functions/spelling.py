"""Old-style respelling of modern text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import col, let
from .pointwise import Rule, letters, marked, rewrite
from .wordwise import count

# ---- Fixed values: the nasal written before each stop class, the swaps, the rate
ANUSVARA = "ಂ"
NASAL_BEFORE = {"ಕಖಗಘ": "ಙ", "ಚಛಜಝ": "ಞ", "ಟಠಡಢ": "ಣ", "ತಥದಧ": "ನ", "ಪಫಬಭ": "ಮ"}
ARCHAIC_SWAPS = (("ರ", "ಱ"), ("ಳ", "ೞ"))
SWAP_RATE = 0.15
VIRAMA = "್"
# Independent vowels ಅ to ಔ and the twelve vowel signs; an inherent vowel
# does not count.
VOWEL_BEARING = "[ಅ-ಔಾಿೀುೂೃೆೇೈೊೋೌ]"
# ---- end of fixed values


def _nasals() -> Rule:
    nasal_before = letters({stop: nasal for stops, nasal in NASAL_BEFORE.items() for stop in stops})

    def respelled(points: np.ndarray) -> np.ndarray:
        signs = np.flatnonzero(points == ord(ANUSVARA))  # END follows at the latest
        nasals = nasal_before[points[signs + 1]]
        known = nasals != points[signs + 1]
        out, sites = points.copy(), signs[known]
        out[sites] = nasals[known]
        return marked(out, sites, VIRAMA)

    return respelled


@F.arrow_udf(T.StringType())
def _homorganic_nasals(texts: pa.Array) -> pa.Array:
    return rewrite(texts, _nasals())


def homorganic_nasals(text: Column | str) -> Column:
    return _homorganic_nasals(col(text))


def swap_sites(target: str) -> str:
    """Regex of a target letter with a vowel-bearing character on both sides; the letter is tested first, most fail there."""
    return f"{target}(?<={VOWEL_BEARING}{target})(?={VOWEL_BEARING})"


def rule_sites() -> dict[str, str]:
    """Regex of the sites of every rule, by the rule's name."""
    rules = {f"nasal {nasal}": f"{ANUSVARA}(?=[{stops}])" for stops, nasal in NASAL_BEFORE.items()}
    return rules | {f"{old}->{new}": swap_sites(old) for old, new in ARCHAIC_SWAPS}


def count_sites(text: Column | str) -> Column:
    """Sites of each rule in a text, in the order of `rule_sites`; counted once per distinct word, no site holds a space."""
    rules = [re.compile(site) for site in rule_sites().values()]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def counted(texts: pa.Array) -> pa.Array:
        return count(texts, rules)

    return counted(col(text))


def archaic_swap(text: Column | str, target: str, archaic: str, key: Column | str,
                 rate: float = SWAP_RATE, seed: int = 0) -> Column:
    """Replace each site with probability ``rate``.

    The coin is a hash of seed, rule, row key and site number, so the same
    row always gets the same spelling whatever its partition.
    """
    text = col(text)
    site = swap_sites(target)

    def respell(parts: Column) -> Column:
        def piece(part: Column, i: Column) -> Column:
            coin = F.pmod(F.xxhash64(F.lit(seed), F.lit(target), parts["k"], i), F.lit(1_000_000))
            letter = F.when(coin < int(rate * 1_000_000), F.lit(archaic)).otherwise(F.lit(target))
            return F.when(i == 0, part).otherwise(F.concat(letter, part))

        return F.array_join(F.transform(parts["p"], piece), "")

    row = F.struct(F.split(text, site).alias("p"), F.xxhash64(col(key)).alias("k"))
    return F.when(text.rlike(site), let(row, respell)).otherwise(text)


def old_style(text: Column | str, key: Column | str, rate: float = SWAP_RATE, seed: int = 0) -> Column:
    out = homorganic_nasals(text)
    for target, archaic in ARCHAIC_SWAPS:
        out = archaic_swap(out, target, archaic, key, rate, seed)
    return out
