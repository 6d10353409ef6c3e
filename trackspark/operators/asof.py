"""Nearest as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, tolerance: float, sequence: str, right_time: str = "ref_time") -> DataFrame:
    """Each row of left with the row of right nearest in time, if within tolerance, else nulls.

    Equally near: the earlier. Of right rows at one time the last by sequence counts if they are not
    later than the left row, else the first. Adds right's
    other columns, right_time, delta and abs_delta. Left rows without time stay, unmatched. One
    shuffle by keys and a sort by time: both sides are put together, and windows carry the last right
    row before and the first one after.
    """
    others = [c for c in right.columns if c not in (*keys, time, sequence)]
    pick = F.struct(F.col("__t").alias("t"), *[F.col(f"__r_{c}").alias(c) for c in others])
    lone = left.select(*keys, F.struct(*left.columns).alias("__left"), F.col(time).cast("double").alias("__t"), F.lit(1).alias("__side"), F.col(sequence).alias("__seq"))
    refs = right.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("double").alias("__t"), F.lit(0).alias("__side"), F.col(sequence).alias("__seq"), *[F.col(c).alias(f"__r_{c}") for c in others])
    both = lone.unionByName(refs, allowMissingColumns=True)
    hit = F.when(F.col("__side") == 0, pick)
    back = Window.partitionBy(*keys).orderBy(F.col("__t").asc_nulls_last(), "__side", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    # the same turned about: the last right row so far is the first one from here on
    ahead = Window.partitionBy(*keys).orderBy(F.col("__t").desc_nulls_first(), "__side", F.desc("__seq")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"__b": F.last(hit, ignorenulls=True).over(back), "__a": F.last(hit, ignorenulls=True).over(ahead)}).where("__side = 1")
    t = F.col("__t")
    before, after = t - F.col("__b.t"), F.col("__a.t") - t
    choose = F.when(F.col("__a").isNull() | (before <= after), F.col("__b")).otherwise(F.col("__a"))
    chosen = both.withColumn("__c", F.when(t.isNotNull(), choose))
    chosen = chosen.withColumn("__c", F.when(F.abs(t - F.col("__c.t")) <= tolerance, F.col("__c")))
    delta = t - F.col("__c.t")
    return chosen.select(*[F.col(f"__left.{c}") for c in left.columns], F.col("__c.t").alias(right_time), *[F.col(f"__c.{c}").alias(c) for c in others], delta.alias("delta"), F.abs(delta).alias("abs_delta"))
