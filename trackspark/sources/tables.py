"""Table sources: CSV with stray names and values, session folders, coefficient files, log lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import epoch_ms_from_iso, epoch_ms_from_ns, number
from ..operators.frames import numbered, priority_union, stripped
from .headers import session_table as session_table
from .logs import tailed as tailed

#: Numeric columns of the reference monitor's beats that are coerced where present.
REFERENCE_NUMBERS = ("beat_sys", "beat_dia", "beat_map", "beat_hr", "count", "artifact_flag")


def text_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header, all values as text, names stripped."""
    return stripped(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path))


def typed_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; types by schema, else inferred in a pass of its own."""
    reader = spark.read.option("header", True)
    return stripped((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def phone_beats(df: DataFrame) -> DataFrame:
    """df with timestamp_ms from timestamp, else timestamp_ms; rows without are dropped. A frame with
    neither column is refused."""
    have = [c for c in ("timestamp", "timestamp_ms") if c in df.columns]
    if not have:
        raise ValueError("neither timestamp nor timestamp_ms")
    return df.withColumn("timestamp_ms", F.coalesce(*[number(F.col(c)) for c in have])).where("timestamp_ms is not null")


def reference_beats(df: DataFrame, numbers: Sequence[str] = REFERENCE_NUMBERS) -> DataFrame:
    """df with timestamp_ms from epoch_ns (required), numbers coerced where present, rows without time dropped."""
    if "epoch_ns" not in df.columns:
        raise ValueError("epoch_ns is missing")
    out = df.withColumns({c: number(F.col(c)) for c in numbers if c in df.columns})
    return out.withColumn("timestamp_ms", epoch_ms_from_ns(number(F.col("epoch_ns")))).where("timestamp_ms is not null")


def sessions(current: DataFrame, past: DataFrame | None = None) -> DataFrame:
    """Current sessions, and past ones whose names aren't current, with origin."""
    if past is None:
        return current.withColumn("origin", F.lit("current"))
    return priority_union(current, past, "session_id")


def reference_rows(df: DataFrame, session: str, order: Sequence[str], systolic: str = "ref_SBP", diastolic: str = "ref_DBP") -> DataFrame:
    """Rows with a finite reference, with row_index per session, ref_MAP and ref_PP."""
    out = numbered(df, [session], order).withColumns({c: number(F.col(c)) for c in (systolic, diastolic)})
    out = out.dropna(subset=[systolic, diastolic])
    return out.withColumns({"ref_MAP": (F.col(systolic) + 2 * F.col(diastolic)) / 3, "ref_PP": F.col(systolic) - F.col(diastolic)})


COEFFICIENTS = "methods map<string, struct<features: array<string>, MAP: array<double>, PP: array<double>, pp_term_scales: map<string, double>>>"


def coefficients(spark: SparkSession, path: str) -> DataFrame:
    """method, target, term, value, scale of a JSON file of models; the first term is the intercept."""
    each = spark.read.schema(COEFFICIENTS).option("multiLine", True).json(path).select(F.explode("methods").alias("method", "m"))
    rows = each.select("method", "m.pp_term_scales", F.concat(F.array(F.lit("intercept")), "m.features").alias("terms"), F.explode(F.array(F.struct(F.lit("MAP").alias("target"), F.col("m.MAP").alias("v")), F.struct(F.lit("PP").alias("target"), F.col("m.PP").alias("v")))).alias("t"))
    rows = rows.select("method", "pp_term_scales", "t.target", F.explode(F.arrays_zip("terms", F.col("t.v").alias("v"))).alias("z"))
    scale = F.when((F.col("target") == "PP") & (F.col("z.terms") != "intercept"), F.try_element_at("pp_term_scales", F.col("z.terms")))
    return rows.select("method", "target", F.col("z.terms").alias("term"), F.col("z.v").alias("value"), F.coalesce(scale, F.lit(1.0)).alias("scale"))


BEAT_EVENT = "event string, timestamp_ms double, beat_index long, rtbp struct<sbp: double, dbp: double>, sin_d struct<sbp: double, dbp: double>, sin_m struct<sbp: double, dbp: double>"


def beat_events(lines: DataFrame, value: str = "value", kind: str = "bp_beat") -> DataFrame:
    """Events of log lines (batch or stream): the JSON object in the line, if it parses and is of the
    kind; other lines are skipped."""
    parsed = F.from_json(F.regexp_extract(value, r"(\{.*\})", 1), BEAT_EVENT)
    return lines.select(parsed.alias("e")).where(F.col("e.event") == kind).select("e.*")


#: The fields of a reference monitor line, in order.
MONITOR = r"^\s*(\S+)\s+SYS=([0-9.]+)\s+DIA=([0-9.]+)\s+MAP=([0-9.]+)\s+HR=([0-9.]+)\s+COUNT=([0-9]+)\s+FLAG=([01])\s*$"


def monitor_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of monitor lines (batch or stream): time and six numbers; a bad time is null, other lines
    are skipped."""
    def part(k: int) -> Column:
        return F.regexp_extract(value, MONITOR, k)

    fields = {"timestamp_ms": epoch_ms_from_iso(part(1)), **{c: number(part(k)) for k, c in enumerate(("sbp", "dbp", "map", "hr", "count", "artifact_flag"), 2)}}
    return lines.where(F.col(value).rlike(MONITOR)).select(*[x.alias(c) for c, x in fields.items()])


def first_present(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first path that exists, on whatever file system."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


def refreshed(spark: SparkSession, source: str, view: str, build: Callable[[DataFrame], DataFrame], rebuild: bool = True) -> DataFrame:
    """The view that build makes of the CSV table source, kept as Parquet at view: made anew, unless
    rebuild is off and there is one with rows. Without either table this fails."""
    if not rebuild and first_present(spark, [view]):
        kept = spark.read.parquet(view)
        if kept.limit(1).count():
            return kept
    if not first_present(spark, [source]):
        raise FileNotFoundError(source)
    build(typed_table(spark, source)).write.mode("overwrite").parquet(view)
    return spark.read.parquet(view)


def read_back(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV table written before, by name; without rows if there is none or it is empty."""
    if not first_present(spark, [path]):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path)


def followed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of the text files that come into a folder, such as log segments that a device's
    files are pulled to. Files must be whole when they come; tailed follows those that grow."""
    return spark.readStream.text(folder)
