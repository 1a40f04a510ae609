"""The two scalar functions that need Python for exact parity: rounding and cache keys."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def python_round(x: Column, digits: int = 4) -> Column:
    """Half-even rounding of the exact binary value."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, digits), na_action="ignore")

    return rounded(x)


def cache_key(model: Column, text: Column) -> Column:
    """SHA-256 of the canonical JSON {"model", "text"} with escapes for all beyond ASCII."""

    @F.pandas_udf("string")
    def key(models: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(json.dumps({"model": m, "text": t}, sort_keys=True).encode()).hexdigest() for m, t in zip(models, texts)])

    return key(model, text)
