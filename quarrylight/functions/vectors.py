"""Vector scalars over ARRAY<FLOAT> columns: JVM-side expressions, and an Arrow kernel for a fixed query vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length or of no length."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length).otherwise(0.0)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine_to(vector: list[float]):
    """An Arrow kernel: cosine of a vector column with one query vector, a matrix product a batch."""
    q = np.asarray(vector, np.float64)
    length = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def kernel(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors))
        fit = np.array([v is not None and len(v) == len(q) for v in vectors], bool)
        if fit.any() and length > 0:
            m = np.stack([np.asarray(v, np.float64) for v in vectors[fit]])
            n = np.sqrt((m * m).sum(1)) * length
            out[fit] = np.divide(m @ q, n, out=np.zeros(len(m)), where=n > 0)
        return pd.Series(out)

    return kernel


def normalised(a: Column) -> Column:
    """Unit length, with -0 as 0; a vector without length stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")) + F.lit(0.0))
