"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every copy of a shuffled document gets a virtual finish time: the tokens of its source up to and
with it, divided by the source's target. Sorted by it, the mix holds the sources in the ratio of
their targets at any point; the budget (the sum of all sizes) is used up at virtual time 1.
No window or group spans a source: cumulative sums go over hash buckets first, and slices of virtual
time hold about the same number of tokens each, however large a source is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: int = 3, most: float = 3.0) -> DataFrame:
    """source, source_size, target of every source of sizes (source, size).

    Sources by code point, null last, weigh 1..cycle, repeating, and share the sum of all sizes; a
    target stops at most times its source's size, the excess is shared again by weight. So target =
    min(most * size, level * weight) with the level at which the targets add up to the sum: with
    sources sorted by most * size / weight, the first k at their stop, it is what is left over the
    weights left, for the smallest k whose level stays within the ratio of source k + 1.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: these windows see no documents
    each = each.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    stop = F.lit(most) * F.col("source_size")
    ratio, order = stop / F.col("weight"), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("ratio", ratio).withColumns({
        "_total": F.sum("source_size").over(Window.partitionBy(F.lit(0))),
        "_weights": F.sum("weight").over(Window.partitionBy(F.lit(0))),
        "_full": F.coalesce(F.sum(stop).over(before), F.lit(0.0)),
        "_gone": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    each = each.withColumn("_level", (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_gone")))
    fits = F.when(F.col("_level") <= F.col("ratio"), F.col("_level"))
    # beyond the right k levels fit too, but fall, so the largest that fits is it
    each = each.withColumn("_level", F.coalesce(F.max(fits).over(Window.partitionBy(F.lit(0))), F.lit(float("inf"))))
    return each.select("source", "source_size", F.least(stop, F.col("_level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: int = 0, cycle: int = 3, most: int = 3, digits: int = 3, slices: int = 1024, carry: Sequence[str] = ()) -> DataFrame:
    """The mix of docs (doc_id, source, text), in words: a row per copy of a document that it takes.

    Returns doc_id, source, size, source_size, target, doc_taken (words taken from all its copies),
    copy (0 to most - 1), virtual_finish, position (words of the mix before it) and taken. A document
    that the mix leaves out has one row with taken 0 and null copy, so each input row has just one
    output row with copy 0 or null. The copy that virtual time 1 falls into is cut, so each source
    gives its target to a word. A null source is a source; null and empty texts have size 0 and are
    never taken; repeated rows each count; if all sizes are 0 targets are 0. Other columns are
    ignored, an empty table gives no rows. Order hangs on doc_id, source, size and seed alone, so
    reruns agree. Columns in carry, whose names must not clash with those above, come along, and put
    rows in order that agree in the rest.
    """
    # one narrow row per document; texts are read once
    sizes = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), *carry))
    # hexadecimal, so that its first digits deal buckets in the order of the whole
    shuffled = sizes.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    shuffled = shuffled.withColumn("_bucket", F.left("_hash", F.lit(digits)))
    goal = targets(sizes, cycle, float(most))
    per = shuffled.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    up_to = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)))
    per = per.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.source", "_bucket", "_base", "source_size", "target")
    inside = Window.partitionBy("source", "_bucket").orderBy("_hash", F.col("doc_id").asc_nulls_last(), "size", *carry).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = shuffled.withColumn("_cum", F.sum("size").over(inside))
    rows = rows.alias("r").join(per.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r._bucket") == F.col("p._bucket")))
    rows = rows.select(*carry, "doc_id", "r.source", "size", "source_size", "target", "r._hash", (F.col("_base") + F.col("_cum")).alias("_cum"))
    # whole words: copy k of a document stands at k source sizes plus the sum before it
    copies = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.struct(
        k.alias("copy"),
        F.try_divide(k * F.col("source_size") + F.col("_cum"), F.col("target")).alias("virtual_finish"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - (k * F.col("source_size") + F.col("_cum") - F.col("size")))).alias("taken"),
    ))
    some = F.filter(copies, lambda c: c["taken"] > 0)
    none = F.array(F.struct(F.lit(None).cast("int").alias("copy"), F.lit(None).cast("double").alias("virtual_finish"), F.lit(0).cast("long").alias("taken")))
    rows = rows.withColumn("_copies", some).withColumn("doc_taken", F.aggregate(F.col("_copies")["taken"], F.lit(0).cast("long"), lambda a, b: a + b))
    rows = rows.select("*", F.explode(F.when(F.size("_copies") > 0, F.col("_copies")).otherwise(none)).alias("c"))
    rows = rows.select(*carry, "doc_id", "source", "size", "source_size", "target", "doc_taken", "_hash", "c.*")
    # the global order by finish time: slices of virtual time hold about budget / slices words each;
    # what the mix leaves out is spread over slices of its own
    aside = (F.lit(-1) - F.pmod(F.xxhash64("_hash"), F.lit(slices))).cast("int")
    slice_ = F.least(F.floor(F.col("virtual_finish") * slices), F.lit(slices)).cast("int")
    rows = rows.withColumn("_slice", F.when(F.col("copy").isNull(), aside).otherwise(slice_))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_slice").agg(F.sum("taken").alias("_words")).withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    inside = Window.partitionBy("_slice").orderBy("virtual_finish", F.col("source").asc_nulls_last(), "_hash", F.col("doc_id").asc_nulls_last(), "size", *carry, "copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("taken").over(inside), F.lit(0))).join(starts.select("_slice", "_start"), "_slice")
    position = F.when(F.col("copy").isNotNull(), F.col("_start") + F.col("_in")).alias("position")
    return rows.select(*carry, "doc_id", "source", "size", "source_size", "target", "doc_taken", "copy", "virtual_finish", position, "taken")
