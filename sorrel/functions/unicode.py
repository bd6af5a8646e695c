"""Unicode normalisation, for which Spark has no expression: Arrow batches through the standard library."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def plain_form(text: pd.Series) -> pd.Series:
    """NFKC without citation marks and white space; null stays null."""
    return text.map(lambda t: None if t is None else "".join(re.sub(r"\[S[0-9]+\]", "", unicodedata.normalize("NFKC", t)).split()))


#: Katakana that have a hiragana form lie at a fixed distance from it.
KATAKANA, DISTANCE = range(0x30A1, 0x30F7), 0x60
_TO_HIRAGANA = {c: c - DISTANCE for c in KATAKANA}


@F.pandas_udf(StringType())
def search_key(text: pd.Series) -> pd.Series:
    """NFKC, lower case, katakana as hiragana, no white space."""
    return text.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).lower().translate(_TO_HIRAGANA).split()))
