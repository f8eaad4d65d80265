"""The library's functions for SQL: a scalar function, an aggregate and table functions, by name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenfold.functions import webpage


@F.pandas_udf(T.IntegerType())
def contact_tier(url: pd.Series, text: pd.Series) -> pd.Series:
    """0 for a contact page, 1 for a page that may hold a contact, else null."""
    return pd.Series([webpage.tier_of(u or "", t or "") for u, t in zip(url, text, strict=True)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def geometric_confidence(logp: pd.Series) -> float:
    """The geometric mean of probabilities given by their logarithms, at most 1; null for none."""
    known = logp.dropna()
    return min(1.0, float(np.exp(known.mean()))) if len(known) else None


@F.udtf(returnType=T.StructType().add("position", "integer").add("href", "string").add("text", "string"))
class Anchors:
    """The links of a page, in their order."""

    def eval(self, page: str) -> Iterator[tuple[int, str, str]]:
        for k, (href, text) in enumerate(webpage.Page(page).anchors):
            yield k, href, text


@F.udtf(returnType=T.StructType().add("ordinal", "integer").add("chunk", "string"))
class Windows:
    """Windows of ``size`` characters that overlap by ``overlap``."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        if not 0 <= overlap < size:
            raise ValueError("an overlap below the size")
        for k, at in enumerate(range(0, max(len(text or "") - overlap, min(1, len(text or ""))), size - overlap)):
            yield k, text[at : at + size]


SCALARS = {"contact_tier": contact_tier}
AGGREGATES = {"geometric_confidence": geometric_confidence}
TABLES = {"anchors": Anchors, "text_windows": Windows}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to a session's SQL; their names."""
    for name, f in {**SCALARS, **AGGREGATES}.items():
        spark.udf.register(name, f)
    for name, t in TABLES.items():
        spark.udtf.register(name, t)
    return sorted({**SCALARS, **AGGREGATES, **TABLES})
