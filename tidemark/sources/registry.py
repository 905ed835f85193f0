"""Site and column registries, as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A registry with more rows is joined by a shuffle.
BROADCAST_ROWS = 100_000


def read_registry(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON registry of the given schema, one document or an entry a line; a malformed entry fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not lines).json(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows, counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def integrity(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """One row: rows of both sides, distinct keys that match, and keys on one side only.

    Null keys match nothing; they count as rows, not as keys.
    """
    a = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_right"))
    count = lambda c: F.count_if(c).alias
    has_left, has_right = F.col("n_left").isNotNull(), F.col("n_right").isNotNull()
    return a.join(b, key, "full_outer").agg(
        F.coalesce(F.sum("n_left"), F.lit(0)).alias(f"n_{names[0]}"), F.coalesce(F.sum("n_right"), F.lit(0)).alias(f"n_{names[1]}"),
        count(has_left & has_right)("matched"), count(has_left & ~has_right)(f"only_{names[0]}"), count(has_right & ~has_left)(f"only_{names[1]}"),
    )
