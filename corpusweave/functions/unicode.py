"""Unicode normal forms: the one text step Spark has no expression for (Arrow-batched)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def compat_fold(text: pd.Series) -> pd.Series:
    """NFKC followed by case folding (``ß`` becomes ``ss``, which ``lower`` does not do)."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())
