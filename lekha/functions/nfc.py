"""Unicode normal form C, which Spark SQL has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import col, collapse



@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalise(text: Column | str) -> Column:
    """NFC, whitespace collapsed and stripped."""
    return collapse(_nfc(col(text)))
