"""Whole-frame projections, positional overlay, priority union, unpivots."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str, keep: Iterable[str]) -> DataFrame:
    """All columns but those kept, and those that have it, get the prefix."""
    keep = set(keep)
    return df.select([F.col(f"`{c}`").alias(c if c in keep or c.startswith(prefix) else prefix + c) for c in df.columns])


def stripped(df: DataFrame) -> DataFrame:
    """Column names without white space around them."""
    return df.toDF(*[c.strip() for c in df.columns])


def with_prefix(df: DataFrame, prefixes: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """Only the columns that begin with one of the prefixes, and those kept."""
    keep = set(keep)
    return df.select([F.col(f"`{c}`") for c in df.columns if c in keep or c.startswith(tuple(prefixes))])


def available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that there are, in the wanted order; the scan reads no others."""
    return df.select([F.col(f"`{c}`") for c in wanted if c in df.columns])


def backed_up(df: DataFrame, columns: Sequence[str], suffix: str = "_export") -> DataFrame:
    """Copies of columns under name + suffix, unless there is such a copy already."""
    return df.withColumns({c + suffix: F.col(f"`{c}`") for c in columns if c in df.columns and c + suffix not in df.columns})


def replaced(df: DataFrame, new: Mapping[str, Column], preserve: bool = False) -> DataFrame:
    """df with new columns; those that exist are replaced, or kept with preserve."""
    return df.withColumns({c: x for c, x in new.items() if not (preserve and c in df.columns)})


def masked(df: DataFrame, columns: Sequence[str], valid: Column, series: Sequence[str] = ("smoothed", "calibrated")) -> DataFrame:
    """Columns null where not valid, and, where missing, further series of them with the same values."""
    out = df.withColumns({c: F.when(valid, F.col(c)) for c in columns})
    return out.withColumns({f"{c}_{s}": F.col(c) for c in columns for s in series if f"{c}_{s}" not in df.columns})


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "row_index", start: int = 0) -> DataFrame:
    """Row numbers within keys, in an order that must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start)


def overlaid(base: DataFrame, overlay: DataFrame, keys: Sequence[str], row: str = "row_index") -> DataFrame:
    """Row i of overlay over row i of base, within keys: its values replace base's, nulls too; columns
    that base lacks are added, null beyond the overlay's end. Overlay rows beyond base's end are left out."""
    on = [*keys, row]
    new = overlay.select(*on, *[F.col(c).alias(f"__{c}") for c in overlay.columns if c not in on], F.lit(True).alias("__hit"))
    joined = base.join(new, on, "left")
    columns = [F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in overlay.columns and c not in on else F.col(c) for c in base.columns]
    return joined.select(*columns, *[F.col(f"__{c}").alias(c) for c in overlay.columns if c not in base.columns])


def priority_union(first: DataFrame, second: DataFrame, key: str, origin: tuple[str, str] = ("current", "past")) -> DataFrame:
    """first, and of second what has a key that first lacks; column origin tells which."""
    rest = second.join(first.select(key).distinct(), key, "left_anti")
    return first.withColumn("origin", F.lit(origin[0])).unionByName(rest.withColumn("origin", F.lit(origin[1])), allowMissingColumns=True)


def unpivoted(df: DataFrame, keep: Sequence[str], groups: Mapping[str, Mapping[str, Column]], name: str) -> DataFrame:
    """A row per input row and group: keep, name, and the group's columns. The input is read once."""
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias(name), *[x.alias(c) for c, x in cs.items()]) for g, cs in groups.items()]))
    return df.select(*keep, rows.alias("__g")).select(*keep, "__g.*")


def with_finite_values(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that have a finite number in any row, from one aggregate over the frame."""
    from ..functions.scalar import finite, number

    found = df.agg(*[F.max(finite(number(F.col(f"`{c}`")))).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [c for k, c in enumerate(columns) if found[k]]
