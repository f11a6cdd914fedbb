"""Vector expressions on ``ARRAY<FLOAT>`` columns, JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def mean_pool(df: DataFrame, by: Sequence[str], vector: str, out: str) -> DataFrame:
    """Element-wise mean vector per ``by`` key. Averages are partial, so a hot key is no hot task."""
    long = df.select(*by, F.posexplode(vector).alias("_pos", "_v"))
    means = long.groupBy(*by, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    cells = F.array_sort(F.collect_list(F.struct("_pos", "_m")))  # one entry per dimension
    return means.groupBy(*by).agg(cells.alias("_cells")).select(
        *by, F.transform("_cells", lambda c: c["_m"]).alias(out)
    )


def with_vectors(df: DataFrame, text: str, encoder, out: str = "embedding") -> DataFrame:
    """Add vectors made by the caller's ``pandas_udf`` from a text column."""
    return df.withColumn(out, encoder(F.col(text)))
