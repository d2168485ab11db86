"""Scalar functions that need Python, as Arrow-batched pandas functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fnv1a64(data: bytes) -> int:
    """64-bit FNV-1a of bytes."""
    h = 0xCBF29CE484222325
    for byte in data:
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(StringType())
def document_identifier(content: pd.Series) -> pd.Series:
    """Sixteen hex digits of the FNV-1a hash of a document's bytes."""
    return content.map(lambda b: None if b is None else f"{fnv1a64(b):016x}")
