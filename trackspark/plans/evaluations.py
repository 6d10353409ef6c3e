"""Queries of the evaluation tables, stored and runtime predictions, and the emit-now match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, ridge, runtime
from ..streaming import match
from .beats import BEATS, ORDER, TARGETS, beats, table
from .queries import CORR, query, r, rounded

MEASURES = ["mae", "rmse", "corr", "signed_bias", "centered_mae", "centered_rmse", "centered_corr", "tracking_gain", "amplitude_ratio", "direction_agreement", "delta_mae"]
BESIDE = ["map_mae", "map_signed_bias", "pp_mae", "pp_signed_bias"]
_TARGET_ROWS = " UNION ALL ".join(f"SELECT scope, session_id, method, series, beat_index, '{t}' AS target, ref_{t} AS ref, pred_{t} AS pred FROM scoped" for t in TARGETS)
_WINDOW = "PARTITION BY scope, method, series, target"


def _style_sql(scoped: str, grid: str) -> str:
    """Measures of the common table expression scoped (scope, session_id, method, series, beat_index, ref_*, pred_*) on grid."""
    gain = "CASE WHEN sum(r * r) = 0 THEN NULL ELSE sum(r * p) / sum(r * r) END"
    return f"""{scoped}, pairs AS ({_TARGET_ROWS}),
    c AS (SELECT *, ref - median(ref) OVER w AS r, pred - median(pred) OVER w AS p FROM pairs WINDOW w AS ({_WINDOW})),
    d AS (SELECT *, r - lag(r) OVER w AS rs, p - lag(p) OVER w AS ps FROM c WINDOW w AS ({_WINDOW} ORDER BY session_id, beat_index)),
    m AS (SELECT scope, method, series, target, count(*) AS n, avg(abs(pred - ref)) AS mae, sqrt(avg((pred - ref) ** 2)) AS rmse, {CORR.format(a='pred', b='ref')} AS corr, avg(pred - ref) AS signed_bias,
        avg(abs(p - r)) AS centered_mae, sqrt(avg((p - r) ** 2)) AS centered_rmse, {CORR.format(a='p', b='r')} AS centered_corr, {gain} AS tracking_gain,
        CASE WHEN stddev_pop(r) = 0 THEN NULL ELSE stddev_pop(p) / stddev_pop(r) END AS amplitude_ratio,
        avg(CASE WHEN rs <> 0 AND ps <> 0 THEN CASE WHEN sign(rs) = sign(ps) THEN 1.0 ELSE 0.0 END END) AS direction_agreement, avg(abs(ps - rs)) AS delta_mae FROM d GROUP BY ALL),
    b AS (SELECT scope, method, series, avg(abs(pred_MAP - ref_MAP)) AS map_mae, avg(pred_MAP - ref_MAP) AS map_signed_bias, avg(abs(pred_PP - ref_PP)) AS pp_mae, avg(pred_PP - ref_PP) AS pp_signed_bias FROM scoped GROUP BY ALL),
    g AS ({grid}), k AS (SELECT g.*, s.series, t.target FROM g, (SELECT unnest(['raw', 'calibrated']) AS series) s, (SELECT unnest(['SBP', 'DBP', 'MAP', 'PP']) AS target) t)
    SELECT k.scope AS session_id, k.method, k.series, k.target, coalesce(m.n, 0) AS n, {', '.join(f'round({x}, 4) AS {x}' for x in [*MEASURES, *BESIDE])},
        CASE WHEN m.n IS NOT NULL THEN CASE WHEN k.target = 'PP' AND tracking_gain < 0 THEN 1 ELSE 0 END END AS inversion_like
    FROM k LEFT JOIN m USING (scope, method, series, target) LEFT JOIN b USING (scope, method, series)"""


_SERIES = BEATS + """, b1 AS (SELECT *, 'raw' AS series FROM beats UNION ALL
    SELECT * REPLACE (1.5 + 0.98 * pred_SBP AS pred_SBP, 1.5 + 0.98 * pred_DBP AS pred_DBP, 1.5 + 0.98 * pred_MAP AS pred_MAP, 1.5 + 0.98 * pred_PP AS pred_PP), 'calibrated' FROM beats)"""


def _styled(df: DataFrame, **more) -> DataFrame:
    moved = {f"pred_{t}": evaluation.calibrated(F.col(f"pred_{t}"), 1.5, 0.98) for t in TARGETS}
    out = evaluation.session_style(df, {"raw": {}, "calibrated": moved}, ORDER, **more)
    return rounded(out.select("session_id", "method", "series", "target", "n", *MEASURES, *BESIDE, "inversion_like"))


@query(f"""WITH {_style_sql(_SERIES + ", scoped AS (SELECT CAST(session_id AS VARCHAR) AS scope, * FROM b1)",
    "SELECT CAST(s_suppkey AS VARCHAR) AS scope, method FROM supplier, (SELECT unnest(['A', 'N', 'R', 'X']) AS method)")}""")
def a12_method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of each session, method, series and target, with rows for what has no data."""
    grid = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), F.explode(F.array(*map(F.lit, "ANRX"))).alias("method"))
    return _styled(beats(spark, sf_dir), totals=False, grid=grid)


@query(f"""WITH {_style_sql(_SERIES + ", scoped AS (SELECT CAST(session_id AS VARCHAR) AS scope, * FROM b1 UNION ALL SELECT 'ALL', * FROM b1)",
    "SELECT DISTINCT s.scope, m.method FROM (SELECT CAST(session_id AS VARCHAR) AS scope FROM beats UNION SELECT 'ALL') s, (SELECT DISTINCT method FROM beats) m")}""")
def a15_session_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per session and over all sessions pooled, whose steps go across their borders."""
    return _styled(beats(spark, sf_dir))


_WIDE = ", ".join(f"round(avg(abs(pred_{t} - ref_{t})), 4) AS {t}_mae, round(sqrt(avg((pred_{t} - ref_{t}) ** 2)), 4) AS {t}_rmse, round(avg(pred_{t} - ref_{t}), 4) AS {t}_bias, round({CORR.format(a=f'pred_{t}', b=f'ref_{t}')}, 4) AS {t}_corr" for t in TARGETS)


@query(f"""WITH {BEATS} SELECT CASE WHEN grouping(session_id) = 1 THEN 'ALL' ELSE CAST(session_id AS VARCHAR) END AS session_id, method, count(*) AS n, {_WIDE}
    FROM beats GROUP BY GROUPING SETS ((method, session_id), (method))""")
def a13_wide_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """17 statistics in wide form, per session and over all."""
    return rounded(evaluation.wide_errors(beats(spark, sf_dir), ["method"], "session_id"))


_MODELS = {"M1": {"MAP": [80.0, 0.3, -20.0], "PP": [30.0, 0.5, 100.0], "pp_term_scales": {"d": 0.8}}, "M2": {"MAP": [85.0, 50.0, -400.0], "PP": [35.0, -60.0, 900.0]}}
_METHODS = (runtime.Method("M1", ("l_quantity", "l_discount"), ("q", "d")), runtime.Method("M2", ("l_tax", "square:l_discount"), ("t", "d2"), base="M1", gap=None, scales=(("d2", 0.65),)))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS t, l_linestatus = 'F' AS ok FROM lineitem),
    m AS (SELECT *, 80 + 0.3 * q - 20 * d AS m1, 30 + 0.5 * q + 80 * d AS p1, CASE WHEN ok THEN 85 + 50 * t - 400 * d * d END AS m2, CASE WHEN ok THEN 35 - 60 * t + 585 * d * d END AS p2 FROM x)
    SELECT l_orderkey, l_linenumber, round(m1, 4) AS M1_MAP_model_raw, round(least(greatest(greatest(m1 + 2 * p1 / 3, m1 - p1 / 3 + 20), 60), 200), 4) AS M1_SBP, round(least(greatest(m1 - p1 / 3, 40), 150), 4) AS M1_DBP_raw,
        round(0.3 * q + 2 * 0.5 * q / 3, 4) AS M1_SBP_term_q, round(CASE WHEN m2 IS NOT NULL THEN least(greatest(m2 + 2 * p2 / 3, 60), 200) END, 4) AS M2_SBP, round(CASE WHEN ok THEN 585.0 END, 4) AS M2_PP_coef_d2,
        round(CASE WHEN ok THEN m1 + 2 * p1 / 3 END, 4) AS M2_SBP_base, round(m2 - p2 / 3 - (m1 - p1 / 3), 4) AS M2_DBP_correction, round(q, 4) AS M2_SBP_raw
    FROM m""")
def p7_runtime_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction, coefficient, term, base and correction columns of two methods; one that is there stays."""
    df = table(spark, sf_dir, "lineitem").withColumns({"M2_output_valid": (F.col("l_linestatus") == "F").cast("int"), "M2_reject_reason": F.lit("ok"), "M2_SBP_raw": F.col("l_quantity")})
    out = runtime.append_columns(df, _MODELS, _METHODS)
    return rounded(out.select("l_orderkey", "l_linenumber", "M1_MAP_model_raw", "M1_SBP", "M1_DBP_raw", "M1_SBP_term_q", "M2_SBP", "M2_PP_coef_d2", "M2_SBP_base", "M2_DBP_correction", "M2_SBP_raw"))


@query(f"""WITH {BEATS}, s AS (SELECT session_id, beat_index, ref_SBP, ref_DBP, 'first' AS method, pred_SBP AS s, pred_DBP AS d FROM beats
    UNION ALL SELECT session_id, beat_index, ref_SBP, ref_DBP, 'second', CASE WHEN l_tax > 0.02 THEN pred_SBP - 3 END, pred_DBP FROM beats)
    SELECT method, count(*) AS n, round(avg(s), 4) AS mean_SBP, round(avg((s + 2 * d) / 3), 4) AS mean_MAP, round(avg(s - d), 4) AS mean_PP FROM s WHERE s IS NOT NULL AND d IS NOT NULL GROUP BY method""")
def m16_stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored columns of two methods as a prediction set."""
    df = beats(spark, sf_dir).withColumns({"M1_SBP_smoothed": F.col("pred_SBP"), "M1_DBP_smoothed": F.col("pred_DBP"), "M2_SBP_smoothed": F.when(F.col("l_tax") > 0.02, F.col("pred_SBP") - 3), "M2_DBP_smoothed": F.col("pred_DBP")})
    rows = runtime.stored_predictions(df, {"first": "M1", "second": "M2"})
    return rounded(rows.groupBy("method").agg(F.count("*").alias("n"), F.avg("pred_SBP").alias("mean_SBP"), F.avg("pred_MAP").alias("mean_MAP"), F.avg("pred_PP").alias("mean_PP")))


@query("""WITH v AS (SELECT user_id, event_id, epoch_us(ts) / 1000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view'),
    c AS (SELECT e.user_id, e.event_id, epoch_us(e.ts) / 1000.0 AS t, (SELECT count(*) FROM v WHERE v.user_id = e.user_id AND v.event_id < e.event_id) AS before FROM events e WHERE event_type = 'click'),
    b AS (SELECT c.event_id, v.event_id AS ref_id, c.t - v.t AS d, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.t - v.t), v.k) AS rn FROM c JOIN v ON v.user_id = c.user_id AND v.k <= c.before AND v.k > c.before - 64)
    SELECT c.event_id, b.ref_id, round(b.d, 3) AS delta_ms FROM c LEFT JOIN b ON b.event_id = c.event_id AND b.rn = 1""")
def r3_emit_now_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click as it comes with the nearest of its user's last 64 views that have come by then; state with a limit, results in files."""
    e = match.event_stream(spark, f"{sf_dir}/events.parquet").where("event_type in ('click', 'view')")
    side = F.when(F.col("event_type") == "click", "left").otherwise("right").alias("side")
    out = match.drained(match.matched_now(e.select(F.col("user_id").alias("key"), side, F.col("event_id").alias("id"), (F.unix_micros("ts") / 1000).alias("t"), F.col("event_id").alias("seq"))))
    return out.select(F.col("id").alias("event_id"), "ref_id", r("delta", 3).alias("delta_ms"))


@query(f"""WITH {BEATS}, x AS (SELECT 0.5 * l_quantity AS a, -90 * l_discount AS b, ref_PP - 90 - 0.5 * l_quantity + 90 * l_discount AS y FROM beats),
    s AS (SELECT sum(a * a) + 25 AS aa, sum(a * b) AS ab, sum(b * b) + 25 AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM x)
    SELECT 'quantity' AS term, round(least(greatest(1 + (bb * ay - ab * yb) / (aa * bb - ab * ab), -3), 3), 6) AS scale FROM s
    UNION ALL SELECT 'discount', round(least(greatest(1 + (aa * yb - ab * ay) / (aa * bb - ab * ab), -3), 3), 6) FROM s""")
def m4_term_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: factors on terms of a fixed model, fitted about 1."""
    c, f = {"intercept": 90.0, "quantity": 0.5, "discount": -90.0}, {"quantity": "l_quantity", "discount": "l_discount"}
    s = ridge.fit_scales(beats(spark, sf_dir), c, f, ["quantity", "discount"], "ref_PP")
    return spark.createDataFrame(list(s.items()), "term string, scale double").select("term", r("scale", 6).alias("scale"))
