"""Tumbling windows over elapsed time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, keys: Sequence[str], elapsed: str, widths: Sequence[float], means: Sequence[str]) -> DataFrame:
    """For each width: keys, window_seconds, window_index, means of the columns, beat_count (rows, also
    those with nulls). All widths come from one pass and one shuffle; null keys are groups too."""
    each = df.withColumn("window_seconds", F.explode(F.array(*[F.lit(float(w)) for w in widths])))
    each = each.withColumn("window_index", F.floor(F.col(elapsed) / F.col("window_seconds")).cast("long"))
    return each.groupBy(*keys, "window_seconds", "window_index").agg(*[F.avg(c).alias(c) for c in means], F.count("*").alias("beat_count"))
