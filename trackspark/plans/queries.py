"""The registered queries over the driver's tables, with their SQL. Names carry the operators' ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics
from ..operators import evaluation, frames, metrics, windows
from .beats import BEATS, PAIRS, TARGETS, beats, table

FLAGSHIP = "q1_tracking_metrics"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Added before rounding, so that decimal data leaves no exact ties, which engines round apart.
OFF_TIES = "1.7e-7"
CORR = "CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN NULL ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if any."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("round(", f"round({OFF_TIES} + ").replace("round_(", "round(")
        return f

    return put


def r(x: Column | str, digits: int = 4) -> Column:
    """Rounded, off ties."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(float(OFF_TIES)), digits)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select([r(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired(beats(spark, sf_dir), ["session_id", "method", "beat_index", "elapsed_s", "status"], TARGETS)


def _ewma_sql(x: str, alpha: float, over: str) -> str:
    """The recursion over the list of values so far."""
    return f"list_reduce(list({x}) OVER ({over}), lambda a, v: {1 - alpha} * a + {alpha} * v)"


# --- metrics: U1, U7, W1, W2, W5, A2-A10, A12 ---


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.centered_samples(_pairs(spark, sf_dir), ["session_id", "method", "target"], ["beat_index"])


_OVER = "PARTITION BY session_id, method, target"
_SAMPLES_SQL = PAIRS + f""", s0 AS (
    SELECT *, ref - median(ref) OVER ({_OVER}) AS ref_centered, pred - median(pred) OVER ({_OVER}) AS pred_centered,
        ref - lag(ref) OVER w AS ref_delta, pred - lag(pred) OVER w AS pred_delta,
        ref - {_ewma_sql('ref', 0.35, _OVER + ' ORDER BY beat_index ROWS BETWEEN 97 PRECEDING AND CURRENT ROW')} AS ref_detrended,
        pred - {_ewma_sql('pred', 0.35, _OVER + ' ORDER BY beat_index ROWS BETWEEN 97 PRECEDING AND CURRENT ROW')} AS pred_detrended
    FROM pairs WINDOW w AS ({_OVER} ORDER BY beat_index)
), samples AS (
    SELECT *, pred - ref AS error, pred_centered - ref_centered AS centered_error, pred_delta - ref_delta AS delta_error,
        pred_detrended - ref_detrended AS detrended_error,
        ref_centered - lag(ref_centered) OVER w AS ref_step, pred_centered - lag(pred_centered) OVER w AS pred_step
    FROM s0 WINDOW w AS ({_OVER} ORDER BY beat_index)
)"""


def _metrics_sql(keys: str, source: str = "samples") -> str:
    def gain(k: str) -> str:
        return f"CASE WHEN sum(ref_{k} * ref_{k}) = 0 THEN NULL ELSE sum(ref_{k} * pred_{k}) / sum(ref_{k} * ref_{k}) END"

    def share(k: str) -> str:
        return f"avg(CASE WHEN ref_{k} <> 0 AND pred_{k} <> 0 THEN CASE WHEN sign(ref_{k}) = sign(pred_{k}) THEN 1.0 ELSE 0.0 END END)"

    family = "".join(
        f"avg(abs({k}_error)) AS {k}_mae, sqrt(avg({k}_error * {k}_error)) AS {k}_rmse, {CORR.format(a=f'pred_{k}', b=f'ref_{k}')} AS {k}_corr, "
        f"{gain(k)} AS {'tracking_gain' if k == 'centered' else f'{k}_gain'}, "
        for k in ("centered", "delta", "detrended")
    )
    return f"""SELECT {keys}, count(*) AS n, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, {CORR.format(a='pred', b='ref')} AS corr,
        avg(error) AS signed_bias, {family} {share('step')} AS direction_agreement, {share('centered')} AS sign_agreement,
        CASE WHEN stddev_pop(ref_centered) = 0 THEN NULL ELSE stddev_pop(pred_centered) / stddev_pop(ref_centered) END AS amplitude_ratio,
        stddev_pop(ref_centered) AS ref_centered_std, stddev_pop(pred_centered) AS pred_centered_std FROM {source} GROUP BY {keys}"""


_MEASURES = ["mae", "rmse", "corr", "signed_bias", "centered_mae", "centered_rmse", "centered_corr", "tracking_gain", "delta_mae", "delta_rmse", "delta_corr", "delta_gain", "detrended_mae", "detrended_rmse", "detrended_corr", "detrended_gain", "direction_agreement", "sign_agreement", "amplitude_ratio", "ref_centered_std", "pred_centered_std"]
_ROUNDED = ", ".join(f"round({m}, 4) AS {m}" for m in _MEASURES)


@query(f"WITH {_SAMPLES_SQL}, m AS ({_metrics_sql('session_id, method, target')}) SELECT session_id, method, target, n, {_ROUNDED} FROM m WHERE n >= 4")
def q1_tracking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A10 over U1/U7, W1, W2, W5, gate F16: all measures per session, method and target."""
    m = metrics.metrics(_samples(spark, sf_dir), ["session_id", "method", "target"]).where("n >= 4")
    return rounded(m.select("session_id", "method", "target", "n", *_MEASURES))


@query(f"""WITH {_SAMPLES_SQL}, m AS ({_metrics_sql('session_id, method, target')})
    SELECT method, target, count(DISTINCT session_id) AS n_sessions, round(avg(n), 4) AS mean_n, round(median(mae), 4) AS median_mae, round(avg(mae), 4) AS mean_mae,
        round(median(rmse), 4) AS median_rmse, round(avg(rmse), 4) AS mean_rmse, round(median(corr), 4) AS median_corr, round(avg(corr), 4) AS mean_corr,
        round(avg(centered_mae), 4) AS mean_centered_mae, round(stddev_samp(centered_mae), 4) AS sd_centered_mae, round(median(delta_mae), 4) AS median_delta_mae,
        round(avg(direction_agreement), 4) AS mean_direction_agreement,
        CAST(sum(CASE WHEN target = 'PP' AND tracking_gain < 0 THEN 1 ELSE 0 END) AS BIGINT) AS inversion_like_sessions
    FROM m GROUP BY method, target""")
def q2_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and medians over sessions."""
    m = metrics.metrics(_samples(spark, sf_dir), ["session_id", "method", "target"])
    s = metrics.summarize(m, ["method", "target"])
    return rounded(s.select("method", "target", "n_sessions", "mean_n", "median_mae", "mean_mae", "median_rmse", "mean_rmse", "median_corr", "mean_corr", "mean_centered_mae", "sd_centered_mae", "median_delta_mae", "mean_direction_agreement", "inversion_like_sessions"))


@query(f"""WITH {PAIRS} SELECT CASE WHEN grouping(session_id) = 1 THEN 'ALL' ELSE CAST(session_id AS VARCHAR) END AS session_id, method, target, count(*) AS n,
        round(avg(abs(pred - ref)), 4) AS mae, round(sqrt(avg((pred - ref) ** 2)), 4) AS rmse, round(avg(pred - ref), 4) AS bias, round({CORR.format(a='pred', b='ref')}, 4) AS corr
    FROM pairs GROUP BY GROUPING SETS ((method, target, session_id), (method, target))""")
def q3_session_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per session and over all."""
    return rounded(metrics.errors_by_session_and_all(_pairs(spark, sf_dir), ["method", "target"]))


@query(f"""WITH {PAIRS}, scoped AS (SELECT CAST(session_id AS VARCHAR) AS scope, * FROM pairs UNION ALL SELECT 'ALL', * FROM pairs),
    c AS (SELECT *, ref - median(ref) OVER w AS r, pred - median(pred) OVER w AS p FROM scoped WINDOW w AS (PARTITION BY scope, method, target)),
    d AS (SELECT *, r - lag(r) OVER w AS rd, p - lag(p) OVER w AS pd FROM c WINDOW w AS (PARTITION BY scope, method, target ORDER BY session_id, beat_index))
    SELECT scope, method, target, count(*) AS n, round(avg(abs(p - r)), 4) AS centered_mae, round(avg(abs(pd - rd)), 4) AS delta_mae,
        round(CASE WHEN sum(r * r) = 0 THEN NULL ELSE sum(r * p) / sum(r * r) END, 4) AS gain FROM d GROUP BY scope, method, target""")
def q4_pooled_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 with pooled medians and steps across session borders in scope ALL (Q7)."""
    out = evaluation.measured(beats(spark, sf_dir), {"raw": {}}, ["beat_index"]).where("n > 0")
    return rounded(out.select(F.col("session_id").alias("scope"), "method", "target", "n", "centered_mae", "delta_mae", F.col("tracking_gain").alias("gain")))


@query(f"""WITH {BEATS}, w AS (SELECT *, unnest([5.0, 10.0, 20.0]) AS window_seconds FROM beats)
    SELECT session_id, method, CAST(window_seconds AS DOUBLE) AS window_seconds, CAST(floor(elapsed_s / window_seconds) AS BIGINT) AS window_index,
        round(avg(ref_SBP), 4) AS ref_SBP, round(avg(pred_SBP), 4) AS pred_SBP, round(avg(elapsed_s), 4) AS elapsed_s, count(*) AS beat_count
    FROM w GROUP BY ALL""")
def q5_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means in 5, 10 and 20 wide windows."""
    return rounded(windows.tumbling(beats(spark, sf_dir), ["session_id", "method"], "elapsed_s", [5, 10, 20], ["ref_SBP", "pred_SBP", "elapsed_s"]))


@query(f"""WITH {PAIRS}, g AS (SELECT DISTINCT s.session_id, m.method, t.target FROM (SELECT s_suppkey AS session_id FROM supplier) s, (SELECT unnest(['A', 'N', 'R', 'X']) AS method) m, (SELECT unnest(['SBP', 'PP']) AS target) t),
    a AS (SELECT session_id, method, target, count(*) AS n, avg(abs(pred - ref)) AS mae FROM pairs WHERE status = 'F' GROUP BY ALL)
    SELECT g.session_id, g.method, g.target, coalesce(a.n, 0) AS n, round(a.mae, 4) AS mae FROM g LEFT JOIN a USING (session_id, method, target)""")
def q6_empty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with n = 0 for groups without data."""
    methods = F.explode(F.array(*map(F.lit, "ANRX")))
    grid = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), methods.alias("method")).withColumn("target", F.explode(F.array(F.lit("SBP"), F.lit("PP"))))
    m = _pairs(spark, sf_dir).where("status = 'F'").groupBy("session_id", "method", "target").agg(F.count("*").alias("n"), statistics.mae(F.col("pred") - F.col("ref")).alias("mae"))
    return rounded(metrics.on_grid(m, grid, ["session_id", "method", "target"]))


@query(f"""WITH {BEATS}, t AS (
        SELECT session_id, method, beat_index, ref_PP AS ref, 'quantity' AS term, 0.4 * l_quantity AS c FROM beats
        UNION ALL SELECT session_id, method, beat_index, ref_PP, 'discount', 30 * l_discount FROM beats
        UNION ALL SELECT session_id, method, beat_index, ref_PP, 'tax', -25 * l_tax FROM beats),
    m AS (SELECT *, ref - median(ref) OVER w AS r, c - median(c) OVER w AS p FROM t WINDOW w AS (PARTITION BY session_id, method, term)),
    d AS (SELECT *, r - lag(r) OVER w AS rs, p - lag(p) OVER w AS ps FROM m WINDOW w AS (PARTITION BY session_id, method, term ORDER BY beat_index)),
    a AS (SELECT session_id, method, term, count(*) AS n, avg(c) AS mean, median(c) AS median, stddev_pop(c) AS std, {CORR.format(a='p', b='r')} AS corr,
            CASE WHEN sum(r * r) = 0 THEN NULL ELSE sum(r * p) / sum(r * r) END AS gain,
            avg(CASE WHEN rs <> 0 AND ps <> 0 THEN CASE WHEN sign(rs) = sign(ps) THEN 1.0 ELSE 0.0 END END) AS direction_agreement,
            CASE WHEN stddev_pop(r) = 0 THEN NULL ELSE stddev_pop(p) / stddev_pop(r) END AS amplitude_ratio FROM d GROUP BY ALL)
    SELECT session_id, method, term, n, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round(corr, 4) AS corr, round(gain, 4) AS gain,
        round(direction_agreement, 4) AS direction_agreement, round(amplitude_ratio, 4) AS amplitude_ratio,
        round(CASE WHEN gain < 0 THEN abs(gain) * coalesce(amplitude_ratio, 0) ELSE 0 END, 4) AS inverse_strength FROM a""")
def q7_term_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of model terms against the reference."""
    return rounded(_diagnostics(spark, sf_dir))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = {"quantity": 0.4 * F.col("l_quantity"), "discount": 30 * F.col("l_discount"), "tax": -25 * F.col("l_tax")}
    rows = frames.unpivoted(beats(spark, sf_dir), ["session_id", "method", "beat_index", "ref_PP"], {t: {"contribution": x} for t, x in terms.items()}, "term")
    return metrics.term_diagnostics(rows.withColumnRenamed("ref_PP", "ref"), ["term"], ["beat_index"], ["session_id", "method"])


@query(ORACLES["q7_term_diagnostics"].rsplit("SELECT session_id, method, term, n, round", 1)[0] + """,
    s AS (SELECT *, CASE WHEN gain < 0 THEN abs(gain) * coalesce(amplitude_ratio, 0) ELSE 0 END AS strength FROM a),
    k AS (SELECT *, row_number() OVER (PARTITION BY session_id, method ORDER BY strength DESC, term) AS rn FROM s WHERE n >= 2 AND strength > 0)
    SELECT method, term, count(*) AS n_sessions, round(avg(strength), 4) AS mean_strength, round(avg(gain), 4) AS mean_gain FROM k WHERE rn = 1 GROUP BY method, term""")
def q8_culprits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest inverse term of each session, rolled up."""
    return rounded(metrics.culprits(_diagnostics(spark, sf_dir), ["session_id", "method"], ["method", "term"]))
