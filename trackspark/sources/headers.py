"""CSV files of one kind whose headers differ: every file is read by the names in its own first line."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.csv as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _header(content: bytes) -> list[str]:
    """The names in the first line, without white space around them."""
    first = next(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline="")), [])
    return [c.strip() for c in first]


def _columns(content: bytes, wanted: Sequence[str]) -> tuple[int, dict[str, pa.Array]]:
    """How many rows a file has, and those of the wanted columns that it has, as text; empty values are
    null. Of columns of one name the first counts; short rows lack values, long ones lose what is too much."""
    names = _header(content)
    if not names:
        return 0, {}
    at = {c: names.index(c) for c in wanted if c in names}
    bad: list[int] = []

    def odd(row: pc.InvalidRow) -> str:
        bad.append(1)
        return "skip"

    places = [f"c{k}" for k in range(len(names))]
    use = [places[k] for k in at.values()] or places[:1]
    body = content[3:] if content.startswith(b"\xef\xbb\xbf") else content
    table = pc.read_csv(
        pa.BufferReader(body), pc.ReadOptions(column_names=places, skip_rows_after_names=1, use_threads=False), pc.ParseOptions(newlines_in_values=True, invalid_row_handler=odd),
        pc.ConvertOptions(include_columns=use, column_types={c: pa.string() for c in use}, strings_can_be_null=True, null_values=[""]),
    )
    if not bad:
        return table.num_rows, {c: table.column(f"c{k}").combine_chunks() for c, k in at.items()}
    rows = [r for r in list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline="")))[1:] if r]
    return len(rows), {c: pa.array([(r[k] or None) if k < len(r) else None for r in rows], pa.string()) for c, k in at.items()}


def _files(spark: SparkSession, root: str, file: str) -> DataFrame:
    return spark.read.format("binaryFile").option("basePath", root).option("pathGlobFilter", file).load(f"{root}/session_id=*")


def _text_table(files: DataFrame, wanted: Sequence[str]) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, found = _columns(batch.column(1)[k].as_py(), wanted)
                if n:
                    each = [found.get(c, pa.nulls(n, pa.string())) for c in wanted]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * n, batch.column(0).type), *each], ["session_id", *wanted])

    schema = T.StructType([files.schema["session_id"], *[T.StructField(c, T.StringType()) for c in wanted]])
    return files.select("session_id", "content").mapInArrow(parse, schema)


def names(spark: SparkSession, root: str, file: str = "*.csv") -> list[str]:
    """All column names of the files, in order of name."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if found := _header(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(found)], ["name"])

    found = _files(spark, root, file).select("content").mapInArrow(heads, "name string").distinct()
    return sorted(r.name for r in found.collect())  # names, not rows


def _numbers(text: Column) -> tuple[Column, Column]:
    """Whether all values are whole numbers, and whether all are numbers."""
    return F.bool_and(text.try_cast("long").isNotNull() | text.isNull()), F.bool_and(text.try_cast("double").isNotNull() | text.isNull())


def session_table(spark: SparkSession, root: str, wanted: Sequence[str] | Mapping[str, str], file: str = "*.csv") -> DataFrame:
    """All sessions' tables below root/session_id=.../, each file by its own header: session_id and the
    wanted columns.

    With types (a mapping) every wanted column is there, null in files that lack it and where a value is
    not of its type. With names only, those that any file has are there, as long, double or string by what
    they hold, which takes a pass of its own. Column names are stripped; names that clash with session_id
    are not read. Only wanted columns are converted, and filters on session_id prune folders. A file is
    read whole by one task, through Spark's own reader, from whatever store. Empty files have no rows."""
    if isinstance(wanted, Mapping):
        types = {c: t for c, t in wanted.items() if c != "session_id"}
        rows = _text_table(_files(spark, root, file), list(types))
        return rows.select("session_id", *[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in types.items()])
    have = set(names(spark, root, file))
    columns = [c for c in wanted if c in have and c != "session_id"]
    rows = _text_table(_files(spark, root, file), columns)
    if not columns:
        return rows
    row = rows.agg(*[x for k, c in enumerate(columns) for x in (f.alias(f"{kind}{k}") for kind, f in zip("ld", _numbers(F.col(f"`{c}`")), strict=True))], *[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    kinds = {c: "string" if not row[f"n{k}"] else "long" if row[f"l{k}"] else "double" if row[f"d{k}"] else "string" for k, c in enumerate(columns)}
    return rows.select("session_id", *[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in kinds.items()])
