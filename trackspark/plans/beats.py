"""The driver's tables in the roles of beats, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import mean_pressure, pulse_pressure
from ..shared import cut

ORDER = ["beat_index"]
TARGETS = {t: (f"ref_{t}", f"pred_{t}") for t in ("SBP", "DBP", "MAP", "PP")}
_OWN = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as beats: a supplier is a session, its lines by date are the beats, return flags are
    methods; price and quantity make the reference, discount and tax the estimate's error."""
    return _valued(_lines(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beats without elapsed_s and status, for what reads them several times: the table's own columns are kept
    by session, and what is worked out of them is so each time."""
    return _valued(cut(_lines(spark, sf_dir).drop("elapsed_s", "status"), "session_id"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's own columns, numbered. Windows stand on these alone, under their last names: what is worked
    out of them is then neither shuffled nor sorted for the numbering, and what is grouped by session
    afterwards finds its rows dealt already."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session_id"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("status"), *_OWN)
    w = Window.partitionBy("session_id")
    rows = rows.withColumns({"beat_index": F.row_number().over(w.orderBy(*_OWN[:3])).cast("long"), "__first": F.min("l_shipdate").over(w)})
    elapsed = F.datediff(F.col("l_shipdate").cast("date"), F.col("__first").cast("date")).cast("long")
    return rows.select("session_id", "method", "beat_index", elapsed.alias("elapsed_s"), "status", *_OWN[3:])


def _valued(rows: DataFrame) -> DataFrame:
    first = [c for c in rows.columns if c not in _OWN]
    rows = rows.select(*first, (F.col("l_extendedprice") / 1000 + 90).alias("ref_SBP"), (F.col("l_quantity") / 2 + 40).alias("ref_DBP"), *_OWN[3:])
    rows = rows.withColumns({"pred_SBP": F.col("ref_SBP") * (1 - F.col("l_discount")), "pred_DBP": F.col("ref_DBP") * (1 - F.col("l_tax"))})
    for s in ("ref", "pred"):
        rows = rows.withColumns({f"{s}_MAP": mean_pressure(F.col(f"{s}_SBP"), F.col(f"{s}_DBP")), f"{s}_PP": pulse_pressure(F.col(f"{s}_SBP"), F.col(f"{s}_DBP"))})
    return rows


#: The same as common table expression "beats".
BEATS = """
raw_ AS (
    SELECT l_suppkey AS session_id, l_returnflag AS method,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS beat_index,
        date_diff('day', min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_suppkey), CAST(l_shipdate AS DATE)) AS elapsed_s,
        l_linestatus AS status, l_extendedprice / 1000 + 90 AS ref_SBP, l_quantity / 2 + 40 AS ref_DBP,
        l_quantity, l_discount, l_tax, l_extendedprice
    FROM lineitem
), beats AS (
    SELECT *, (ref_SBP + 2 * ref_DBP) / 3 AS ref_MAP, ref_SBP - ref_DBP AS ref_PP,
        (pred_SBP + 2 * pred_DBP) / 3 AS pred_MAP, pred_SBP - pred_DBP AS pred_PP
    FROM (SELECT *, ref_SBP * (1 - l_discount) AS pred_SBP, ref_DBP * (1 - l_tax) AS pred_DBP FROM raw_)
)"""

#: Common table expression "pairs": a row per target.
PAIRS = BEATS + """, pairs AS (
    SELECT session_id, method, beat_index, elapsed_s, status, 'SBP' AS target, ref_SBP AS ref, pred_SBP AS pred FROM beats
    UNION ALL SELECT session_id, method, beat_index, elapsed_s, status, 'DBP', ref_DBP, pred_DBP FROM beats
    UNION ALL SELECT session_id, method, beat_index, elapsed_s, status, 'MAP', ref_MAP, pred_MAP FROM beats
    UNION ALL SELECT session_id, method, beat_index, elapsed_s, status, 'PP', ref_PP, pred_PP FROM beats
)"""
