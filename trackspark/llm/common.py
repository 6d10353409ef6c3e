"""Small helpers that the operators share: checkpoints, the shared folder, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything but ASCII white space (space, tab, line feed, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"


_SCRATCH: list[tuple[SparkSession, str]] = []
_TABLES: dict[str, str] = {}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a full URI, on the default file system if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: spark.checkpoint.dir, else the
    checkpoint folder that was set before; else, on a local master only, a new temporary folder.
    A path without a scheme is on the default file system, as it is for Spark itself."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trackspark-")
    found = qualified(spark, found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name not used before, below the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/trackspark-scratch/{kind}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """What is written to new folders inside is removed at the end; results that read it must be
    written elsewhere by then."""
    before = len(_SCRATCH)
    try:
        yield
    finally:
        drop_scratch(before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it as a Parquet table in the shared folder: a lost executor loses
    nothing, and unlike a checkpoint the table has a size that Spark plans joins by. Tables of a
    session are removed when its driver ends; what a killed driver leaves lies below trackspark-scratch."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_in_buckets(df: DataFrame, column: str) -> DataFrame:
    """cut_lineage, in as many buckets of column as a shuffle has partitions: joins on column take the
    table as it lies. Pages end by their size after any row: else a hundred rows of megabytes are one page,
    and readers keep as much again twice beside the heap to decompress it."""
    spark = df.sparkSession
    path, name = new_folder(spark, "buckets"), f"trackspark_{uuid.uuid4().hex}"
    _TABLES[path] = name
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).option("parquet.page.size.row.check.min", "1").format("parquet").saveAsTable(name)
    return spark.table(name)


@atexit.register
def drop_scratch(since: int = 0) -> None:
    """Removes the tables that cut_lineage has written, but the first since ones."""
    while len(_SCRATCH) > since:
        spark, path = _SCRATCH.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            if path in _TABLES:
                spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        except Exception:  # noqa: BLE001  the driver's JVM is gone already
            return


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores before it, so that it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def chunk_pairs(members: DataFrame, by: list[str], name: str, left: Column, size: Column, limit: int) -> DataFrame:
    """Deals the members of each group of by to chunks, and chunks to pairs, so that whoever has to be
    compared meets in one pair (_i, _j) of chunks at least: all rows of left meet each other and all
    other rows; the others needn't meet among themselves. Rows are dealt by a hash of column name, and
    size is what a row takes of a chunk's limit.
    A group within the limit is one chunk, so it is copied once; of a larger one a row is copied
    as often as there are chunks to meet, and never into pairs of rows."""
    parts = lambda total: F.ceil(total / F.lit(limit)).cast("int")
    sums = members.select(*by, left.alias("_left"), size.cast("long").alias("_size")).groupBy(*by, "_left").agg(F.sum("_size").alias("_sum"))
    sums = sums.groupBy(*by).agg(F.sum(F.when(F.col("_left"), F.col("_sum")).otherwise(0)).alias("_a"), F.sum("_sum").alias("_all"))
    sums = sums.select(*by, F.when(F.col("_all") <= limit, 1).otherwise(F.greatest(parts(F.col("_a")), F.lit(1))).alias("_s"), F.when(F.col("_all") <= limit, 0).otherwise(parts(F.col("_all") - F.col("_a"))).alias("_m"))
    rows = members.withColumn("_left", left).join(sums, by)
    at = F.pmod(F.xxhash64(name), F.when(F.col("_left") | (F.col("_m") == 0), F.col("_s")).otherwise(F.col("_m"))).cast("int")
    rows = rows.withColumn("_at", F.when(F.col("_left") | (F.col("_m") == 0), at).otherwise(F.col("_s") + at))
    # chunks below _s meet all chunks, those from _s on only the former
    meets = F.sequence(F.lit(0), F.when(F.col("_at") < F.col("_s"), F.col("_s") + F.col("_m")).otherwise(F.col("_s")) - 1)
    pair = F.transform(meets, lambda t: F.struct(F.least(t, F.col("_at")).alias("_i"), F.greatest(t, F.col("_at")).alias("_j")))
    return rows.select(*members.columns, "_left", "_at", F.explode(pair).alias("_p")).select("*", "_p._i", "_p._j").drop("_p")


def in_groups(rows: DataFrame, by: list[str], start: Callable[[], Callable[[pa.Table | None], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """Calls what start() returns on the table of each group, groups being runs of equal by in sorted
    partitions, and on None at the end of a partition. A group must fit in memory. Unlike in a grouped
    map, small groups cost no batch of their own, and work may be held back over groups."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        work = start()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            change = np.zeros(table.num_rows - 1, bool)
            for c in by:
                x = table.column(c).combine_chunks()
                x = x.dictionary_encode().indices if not pa.types.is_integer(x.type) else x
                x = x.to_numpy(zero_copy_only=False)
                change |= x[1:] != x[:-1]
            ends = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
            if held and any(held[-1].column(c)[-1] != table.column(c)[0] for c in by):
                yield from work(pa.concat_tables(held))
                held = []
            for a, b in zip(ends, ends[1:], strict=False):
                held.append(table.slice(a, b - a))
                if b < table.num_rows:
                    yield from work(pa.concat_tables(held))
                    held = []
        if held:
            yield from work(pa.concat_tables(held))
            held = []
        yield from work(None)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(over, schema)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.up))), np.int64, len(self.up))


def bounded_batches(spark: SparkSession, limit: int = 1 << 22) -> None:
    """Arrow batches to Python end at limit bytes, so that a run of long texts fits in memory.
    A smaller limit that the session has is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name, None)
    if not have or not have.isdigit() or int(have) > limit:
        spark.conf.set(name, str(limit))
