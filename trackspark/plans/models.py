"""Queries of held-out models, pulse candidates and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, baseline, projection, ridge, training, windows
from .beats import BEATS, TARGETS, beats
from .queries import _ewma_sql, query, rounded

REFS = {"MAP": "ref_MAP", "PP": "ref_PP"}
BOUNDS = {"MAP": (40.0, 180.0), "PP": (10.0, 120.0)}


def _left_out(table: str, x: str, y: str, alpha: float, name: str) -> str:
    """Common table expressions: sums per (target, method, session) and the slope and means of the rest."""
    s = f"sum({x}) AS x, sum({y}) AS y, sum({x} * {x}) AS xx, sum({x} * {y}) AS xy"
    return f"""{name}_s AS (SELECT target, method, session_id, count(*) AS n, {s} FROM {table} GROUP BY ALL),
    {name}_t AS (SELECT target, method, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM {name}_s GROUP BY ALL),
    {name}_f AS (SELECT s.target, s.method, s.session_id, t.n - s.n AS n, (t.x - s.x) / (t.n - s.n) AS mx, (t.y - s.y) / (t.n - s.n) AS my, t.xx - s.xx AS xx, t.xy - s.xy AS xy
        FROM {name}_s s JOIN {name}_t t ON s.target = t.target AND s.method = t.method WHERE t.n - s.n >= {2 if name == 'lev' else 1}),
    {name} AS (SELECT *, (xy - n * mx * my) / ((xx - n * mx * mx) * (1 + {alpha} / n)) AS slope FROM {name}_f)"""


@query(f"""WITH {BEATS}, y AS (SELECT session_id, method, beat_index, l_quantity AS q, unnest(['MAP', 'PP']) AS target, unnest([ref_MAP, ref_PP]) AS y FROM beats),
    r AS (SELECT *, row_number() OVER (PARTITION BY method, session_id, target ORDER BY beat_index) AS place FROM y),
    u AS (SELECT target, method, session_id, median(q) AS q, median(y) AS y FROM r WHERE place <= 30 GROUP BY ALL),
    {_left_out('u', 'q', 'y', 10.0, 'lev')},
    v AS (SELECT y.target, y.method, y.session_id, y.q - u.q AS q, y.y - u.y AS y FROM y JOIN u ON y.target = u.target AND y.method = u.method AND y.session_id = u.session_id),
    {_left_out('v', 'q', 'y', 1.0, 'chg')},
    b AS (SELECT u.*, lev.my AS population, lev.my + 0.9 * (lev.slope * (u.q - lev.mx)) AS level FROM u JOIN lev ON u.target = lev.target AND u.method = lev.method AND u.session_id = lev.session_id),
    c AS (SELECT *, CASE WHEN level BETWEEN CASE target WHEN 'MAP' THEN 40 ELSE 10 END AND CASE target WHEN 'MAP' THEN 180 ELSE 120 END THEN level ELSE population END AS base FROM b)
    SELECT y.session_id, y.method, y.beat_index, y.target, round(c.base, 4) AS baseline, round(c.base + chg.my + chg.slope * (y.q - c.q - chg.mx), 4) AS prediction
    FROM y LEFT JOIN c ON y.target = c.target AND y.method = c.method AND y.session_id = c.session_id LEFT JOIN chg ON y.target = chg.target AND y.method = chg.method AND y.session_id = chg.session_id""")
def m12_adaptive_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session of each method by level and change models that haven't seen it."""
    out = baseline.held_out(beats(spark, sf_dir), ["l_quantity"], REFS, "session_id", "beat_index", "method", ("median",), shrinkage=0.9, bounds=BOUNDS)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}_baseline").alias("baseline"), F.col(f"{t}_heldout").alias("prediction")) for t in REFS]))
    return rounded(out.select("session_id", "method", "beat_index", each.alias("e")).select("session_id", "method", "beat_index", "e.*"))


@query()
def m12_rich_blend_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels from all statistics of the discovered columns, leaving each session out, with the movement of the plain models blended in, raw and smoothed."""
    rows, names = beats(spark, sf_dir), ["l_quantity", "l_discount"]
    rich = training.rich_features(rows, ["l_"], ["l_extendedprice"])
    out = baseline.held_out(rows, names, REFS, "session_id", "beat_index", "method", baseline.STATISTICS, rich, bounds=BOUNDS)
    for t, gain, alpha in (("MAP", 0.25, 0.3), ("PP", 0.25, 0.5)):
        dynamic = ridge.linear(ridge.fit(rows, names, f"ref_{t}", 1.0), names)
        out = training.blended_series(out, F.col(f"{t}_baseline"), dynamic, gain, ["method", "session_id"], ["beat_index"], alpha, name=f"{t}_blend")
    return rounded(out.select("session_id", "method", "beat_index", *[f"{t}_{k}" for t in REFS for k in ("baseline", "heldout", "blend", "blend_smoothed")]))


@query()
def m12_shared_baseline_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One method's levels for all methods, each method's own changes, leaving each session out."""
    out = baseline.held_out(beats(spark, sf_dir), ["l_quantity", "l_discount"], REFS, "session_id", "beat_index", "method", baseline.STATISTICS, shared="N", bounds=BOUNDS)
    return rounded(out.select("session_id", "method", "beat_index", *[f"{t}_{k}" for t in REFS for k in ("baseline", "heldout")]))


_BY = "PARTITION BY session_id, method ORDER BY beat_index ROWS BETWEEN {} PRECEDING AND CURRENT ROW"


@query(f"""WITH {BEATS}, c AS (SELECT session_id, method, beat_index, pred_MAP AS rm, pred_PP AS rp, 60 + 0.5 * l_quantity AS dm, 30 + 40 * l_discount AS dp, row_number() OVER (PARTITION BY session_id, method ORDER BY beat_index) AS place FROM beats WHERE l_tax > 0),
    s AS (SELECT *, {', '.join(f"{_ewma_sql(x, a, _BY.format(117 if a == 0.3 else 60))} AS s{x}" for x, a in (('rm', 0.3), ('dm', 0.3), ('rp', 0.5), ('dp', 0.5)))} FROM c),
    m AS (SELECT session_id, method, {', '.join(f'median({x}) AS m{x}' for x in ('dm', 'dp', 'sdm', 'sdp'))} FROM s WHERE place <= 30 GROUP BY ALL),
    b AS (SELECT s.*, rm + g * (dm - mdm) AS bm, rp + 0.4 * (dp - mdp) AS bp, srm + g * (sdm - msdm) AS sbm, srp + 0.4 * (sdp - msdp) AS sbp FROM (SELECT s.*, mdm, mdp, msdm, msdp, CASE s.method WHEN 'R' THEN 0.6 ELSE 0.25 END AS g FROM s JOIN m ON s.session_id = m.session_id AND s.method = m.method) s)
    SELECT beats.session_id, beats.method, beats.beat_index, round(bm, 4) AS map_raw, round(bp, 4) AS pp_raw, round(sbm, 4) AS map, round(sbm - sbp / 3 + sbp, 4) AS sbp, round(bm - bp / 3, 4) AS dbp_raw
    FROM beats LEFT JOIN b ON beats.session_id = b.session_id AND beats.beat_index = b.beat_index""")
def m11_tracking_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runtime blend with a gain of its own for one method; rows without tax have no course."""
    known = F.col("l_tax") > 0
    rich = {t: F.when(known, F.col(f"pred_{t}")) for t in REFS}
    dynamic = {"MAP": F.when(known, 60 + 0.5 * F.col("l_quantity")), "PP": F.when(known, 30 + 40 * F.col("l_discount"))}
    out = training.tracking_blend(beats(spark, sf_dir), rich, dynamic, {"MAP": {None: 0.25, "R": 0.6}, "PP": {None: 0.4}}, "session_id", ["beat_index"])
    return rounded(out.select("session_id", "method", "beat_index", F.col("blend_MAP_raw").alias("map_raw"), F.col("blend_PP_raw").alias("pp_raw"), F.col("blend_MAP").alias("map"), F.col("blend_SBP").alias("sbp"), F.col("blend_DBP_raw").alias("dbp_raw")))


@query(f"""WITH {BEATS}, v AS (SELECT session_id, beat_index, ref_PP, pred_PP, l_discount AS d, l_tax AS t,
        l_discount - median(l_discount) OVER s AS x, l_tax - median(l_tax) OVER s AS z, ref_PP - median(ref_PP) OVER s - (pred_PP - median(pred_PP) OVER s) AS y FROM beats WHERE status = 'F' WINDOW s AS (PARTITION BY session_id)),
    g AS (SELECT session_id, count(*) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy,
        sum(d) AS d, sum(t) AS t, sum(ref_PP) AS r, sum(d * d) AS dd, sum(t * t) AS tt, sum(ref_PP * ref_PP) AS rr, sum(d * ref_PP) AS dr, sum(t * ref_PP) AS tr FROM v GROUP BY session_id),
    f AS (SELECT a.session_id, {', '.join(f'w.{c} - a.{c} AS {c}' for c in 'n x z y xx zz xz xy zy d t r dd tt rr dr tr'.split())} FROM g a, (SELECT {', '.join(f'sum({c}) AS {c}' for c in 'n x z y xx zz xz xy zy d t r dd tt rr dr tr'.split())} FROM g) w WHERE w.n > a.n),
    m AS (SELECT *, x / n AS mx, z / n AS mz, y / n AS my, (xx - x * x / n) * (1 + 1.0 * 4 / n) AS cxx, (zz - z * z / n) * (1 + 1.0 * 4 / n) AS czz, xz - x * z / n AS cxz, xy - x * y / n AS cxy, zy - z * y / n AS czy,
        abs((n * dr - d * r) / sqrt((n * dd - d * d) * (n * rr - r * r))) AS sd, abs((n * tr - t * r) / sqrt((n * tt - t * t) * (n * rr - r * r))) AS st FROM f),
    k AS (SELECT *, (cxy * czz - czy * cxz) / (cxx * czz - cxz * cxz) AS ax, (czy * cxx - cxy * cxz) / (cxx * czz - cxz * cxz) AS az, CASE WHEN sd > st THEN cxy / cxx ELSE 0 END AS bx, CASE WHEN sd > st THEN 0 ELSE czy / czz END AS bz FROM m)
    SELECT v.session_id, beat_index, round(least(greatest(pred_PP + my + ax * (v.x - mx) + az * (v.z - mz), 15), 100), 4) AS candidate_a, round(least(greatest(pred_PP + my + bx * (v.x - mx) + bz * (v.z - mz), 15), 100), 4) AS candidate_b
    FROM v LEFT JOIN k ON v.session_id = k.session_id""")
def m14_fold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both corrected pulse pressures of the valid beats, the second by each fold's own strongest feature; unsmoothed."""
    out, _ = projection.candidates(beats(spark, sf_dir), [], ["l_discount", "l_tax"], "ref_PP", "pred_PP", "session_id", ["beat_index"], F.col("status") == "F", 1, smoothing=1.0)
    return rounded(out.select("session_id", "beat_index", "candidate_a", "candidate_b"))


@query()
def m14_candidate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficients of both candidates' folds, on standardised features."""
    _, models = projection.candidates(beats(spark, sf_dir), ["l_quantity"], ["l_discount", "l_tax", "l_extendedprice"], "ref_PP", "pred_PP", "session_id", ["beat_index"], F.col("status") == "F", 2)
    return rounded(models)


#: What methods are searched with, and the same as SQL: lags, signs and parts taken.
SEARCHES = {"A": align.Search(signs=(1.0,)), "R": align.Search(lags=(-3, -2, -1, 0, 1, 2, 3), blend=0.85)}


def _align_sql(source: str, order: str, digits: int, place: str) -> str:
    """All candidates, each scored by itself."""
    keys, default = ("session_id", "method"), align.Search()
    g = ", ".join(keys)

    def on(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)

    def c(x: str, y: str, near: bool) -> str:
        w = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL" + (" AND i <= near AND near >= 4)" if near else ")")
        return f"CASE WHEN count(*) {w} >= 3 AND var_pop({x}) {w} > 1e-24 AND var_pop({y}) {w} > 1e-24 THEN covar_pop({x}, {y}) {w} / sqrt(var_pop({x}) {w} * var_pop({y}) {w}) END"

    def grid(m: str, s: align.Search) -> str:
        return f"SELECT '{m}' AS method, unnest({list(s.lags)}) AS lag, {s.blend} AS part"

    grids = " UNION ALL ".join(grid(m, SEARCHES.get(m, default)) for m in ("A", "N", "R"))
    weights = dict(zip("psd", default.weights, strict=True))

    def score(span: str) -> str:
        top = " + ".join(f"coalesce({k}_{span}, 0) * {w}" for k, w in weights.items())
        low = " + ".join(f"CASE WHEN {k}_{span} IS NULL THEN 0 ELSE {w} END" for k, w in weights.items())
        return f"({top}) / nullif({low}, 0)"

    def best(name: str, scored: str) -> str:
        return f"""{name}_n AS (SELECT * FROM {scored} WHERE near_ IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY near_ DESC, lag, sign DESC, gain) = 1),
    {name}_w AS (SELECT * FROM {scored} WHERE wide_ IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY wide_ DESC, lag, sign DESC, gain) = 1),
    {name} AS (SELECT e.session_id, e.method, CASE WHEN further THEN e.wl ELSE e.nl END AS lag, CASE WHEN further THEN e.ws ELSE e.ns END AS sign, CASE WHEN further THEN e.wg ELSE e.ng END AS gain FROM (
        SELECT k.session_id, k.method, n.lag AS nl, n.sign AS ns, n.gain AS ng, w.lag AS wl, w.sign AS ws, w.gain AS wg, w.wide_ IS NOT NULL AND (n.near_ IS NULL OR (n.near_ < {default.reliable} AND w.wide_ > n.near_)) AS further
        FROM (SELECT DISTINCT {g} FROM o) k LEFT JOIN {name}_n n ON {on('k', 'n')} LEFT JOIN {name}_w w ON {on('k', 'w')}) e)"""

    return f"""{source}, o AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {order}) AS i, count(*) OVER (PARTITION BY {g}) AS n, least({default.calibration}, count(*) OVER (PARTITION BY {g})) AS near,
        median(pred_MAP) OVER (PARTITION BY {g}) AS mm, median(pred_PP) OVER (PARTITION BY {g}) AS mp FROM src),
    lags AS ({grids}), s AS (SELECT a.*, lag, part, coalesce(b.pred_MAP, a.pred_MAP) AS sm, coalesce(b.pred_PP, a.pred_PP) AS sp FROM o a JOIN lags USING (method) LEFT JOIN o b ON {on('a', 'b')} AND b.i = a.i - lag),
    d AS (SELECT *, sm - lag(sm) OVER w AS dm, sp - lag(sp) OVER w AS dp, {', '.join(f'ref_{t} - lag(ref_{t}) OVER w AS g{t}' for t in TARGETS)} FROM s WHERE n >= 4 WINDOW w AS (PARTITION BY {g}, lag ORDER BY i)),
    cm AS (SELECT {g}, lag, {c('dm', 'gMAP', True)} AS near_, {c('dm', 'gMAP', False)} AS wide_ FROM d GROUP BY ALL),
    sm AS (SELECT {g}, lag, sign, {default.gains[0]} AS gain, round_(sign * near_, 9) AS near_, round_(sign * wide_, 9) AS wide_ FROM cm, (SELECT unnest([1.0, -1.0]) AS sign) WHERE method <> 'A' OR sign = 1),
    {best('one', 'sm')},
    e AS (SELECT d.*, one.sign * one.gain * x.dm AS base FROM d JOIN one ON {on('d', 'one')} JOIN d x ON {on('d', 'x')} AND d.i = x.i AND x.lag = one.lag),
    q AS (SELECT e.*, sign, gain, sign * gain * dp AS c FROM e, (SELECT unnest([1.0, -1.0]) AS sign), (SELECT unnest({list(default.gains)}) AS gain) WHERE method <> 'A' OR sign = 1),
    cp AS (SELECT {g}, lag, sign, gain, {', '.join(f"{c(x, y, near)} AS {k}_{span}" for span, near in (('near', True), ('wide', False)) for k, x, y in (('p', 'c', 'gPP'), ('s', '(base + 2 * c / 3)', 'gSBP'), ('d', '(base - c / 3)', 'gDBP')))} FROM q GROUP BY ALL),
    sq AS (SELECT {g}, lag, sign, gain, round_({score('near')}, 9) AS near_, round_({score('wide')}, 9) AS wide_ FROM cp),
    {best('two', 'sq')},
    z AS (SELECT o.*, one.lag AS l1, one.sign AS s1, one.gain AS g1, two.lag AS l2, two.sign AS s2, two.gain AS g2, a.sm AS am, a.part, b.sp AS bp FROM o LEFT JOIN one ON {on('o', 'one')} LEFT JOIN two ON {on('o', 'two')}
        LEFT JOIN s a ON {on('o', 'a')} AND o.i = a.i AND a.lag = coalesce(one.lag, 0) LEFT JOIN s b ON {on('o', 'b')} AND o.i = b.i AND b.lag = coalesce(two.lag, 0))
    SELECT session_id, method, {place}, round(CASE WHEN n < 4 THEN pred_MAP ELSE (1 - part) * pred_MAP + part * (mm + coalesce(s1, 1) * coalesce(g1, 1) * (am - mm)) END, {digits}) AS pred_MAP,
        round(CASE WHEN n < 4 THEN pred_PP ELSE (1 - part) * pred_PP + part * (mp + coalesce(s2, 1) * coalesce(g2, 1) * (bp - mp)) END, {digits}) AS pred_PP{{more}} FROM z"""


_MEANS = ", ".join(f"avg({s}_{t}) AS {s}_{t}" for s in ("ref", "pred") for t in TARGETS)
_WINDOWS = f"WITH {BEATS}, src AS (SELECT session_id, method, CAST(floor(elapsed_s / 20.0) AS BIGINT) AS window_index, {_MEANS} FROM beats GROUP BY ALL)"


@query(_align_sql(_WINDOWS, "window_index", 3, "window_index").replace("{more}", ", CAST(coalesce(l1, 0) AS INTEGER) AS map_lag, CAST(coalesce(l2, 0) AS INTEGER) AS pp_lag, round(coalesce(s2, 1), 3) AS pp_sign"))
def m15_grid_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag, sign and gain that align windows with the reference."""
    means = [f"{s}_{t}" for s in ("ref", "pred") for t in TARGETS]
    w = windows.tumbling(beats(spark, sf_dir), ["session_id", "method"], "elapsed_s", [20], means)
    out = align.aligned(w, ["session_id", "method"], "window_index", "method", SEARCHES)
    return rounded(out.select("session_id", "method", "window_index", "pred_MAP", "pred_PP", "map_lag", "pp_lag", "pp_sign"), 3)


@query(_align_sql(f"WITH {BEATS}, src AS (SELECT session_id, method, beat_index, elapsed_s, {', '.join(f'{s}_{t}' for s in ('ref', 'pred') for t in TARGETS)} FROM beats WHERE method = 'N')", "elapsed_s, beat_index", 3, "beat_index").replace("{more}", ""))
def m17_aligned_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beats of one method, aligned like windows."""
    out = align.aligned_beats(beats(spark, sf_dir).where("method = 'N'"), "N", "beat_index")
    return rounded(out.select("session_id", "method", "beat_index", "pred_MAP", "pred_PP"), 3)
