"""Further queries: joins, gates, features, models, scalars, reshaping and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, statistics
from ..operators import asof, baseline, features, frames, metrics, projection, quality, ridge, smooth, training, windows
from ..streaming import match
from .beats import BEATS, PAIRS, TARGETS, beats, kept, table
from .queries import CORR, _ewma_sql, _pairs, query, r, rounded

# --- joins ---


@query("""WITH l AS (SELECT event_id, user_id, ts AS t FROM events WHERE event_type = 'click'), rr AS (SELECT user_id, ts AS t, value, event_id AS rid FROM events WHERE event_type = 'view'),
    b AS (SELECT l.event_id, l.user_id, rr.value, rr.rid, epoch_us(l.t) - epoch_us(rr.t) AS d,
            row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.t) - epoch_us(rr.t)), rr.t, rr.rid DESC) AS rn FROM l JOIN rr ON l.user_id = rr.user_id AND abs(epoch_us(l.t) - epoch_us(rr.t)) <= 21600000000)
    SELECT l.event_id, l.user_id, b.rid AS ref_id, round(b.value, 4) AS ref_value, round(b.d / 1000.0, 3) AS delta_ms, round(abs(b.d) / 1000.0, 3) AS abs_delta_ms
    FROM l LEFT JOIN b ON l.event_id = b.event_id AND b.rn = 1""")
def j1_nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with its user's nearest view within six hours."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0)
    left = e.where("event_type = 'click'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select("user_id", "t", "event_id", F.col("event_id").alias("ref_id"), F.col("value").alias("ref_value"))
    out = asof.nearest(left, right, ["user_id"], "t", 6 * 3600 * 1000.0, "event_id")
    return out.select("event_id", "user_id", "ref_id", r("ref_value").alias("ref_value"), r("delta", 3).alias("delta_ms"), r("abs_delta", 3).alias("abs_delta_ms"))


@query("""WITH b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS row_index, o_totalprice FROM orders),
    o AS (SELECT c_custkey AS o_custkey, i AS row_index, CASE WHEN i = 1 THEN NULL ELSE c_acctbal + i END AS o_totalprice, c_mktsegment AS segment FROM customer, (SELECT unnest([0, 1, 2]) AS i))
    SELECT b.o_custkey, b.o_orderkey, b.row_index, round(CASE WHEN o.row_index IS NOT NULL THEN o.o_totalprice ELSE b.o_totalprice END, 2) AS o_totalprice, o.segment FROM b LEFT JOIN o USING (o_custkey, row_index)""")
def j3_positional_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row i over row i, nulls too."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    base = frames.numbered(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).withColumn("row_index", F.col("row_index").cast("long")).drop("o_orderdate")
    c = table(spark, sf_dir, "customer").withColumn("row_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    over = c.select(F.col("c_custkey").alias("o_custkey"), "row_index", F.when(F.col("row_index") != 1, F.col("c_acctbal") + F.col("row_index")).alias("o_totalprice"), F.col("c_mktsegment").alias("segment"))
    return frames.overlaid(base, over, ["o_custkey"]).withColumn("o_totalprice", r("o_totalprice", 2))


@query("""SELECT s_suppkey AS key, s_acctbal AS balance, 'current' AS origin FROM supplier
    UNION ALL SELECT c_custkey, c_acctbal, 'past' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def j8_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current set, and of the past what it lacks."""
    now = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    past = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return frames.priority_union(now, past, "key")


@query("""SELECT f.r_name AS held_out, count(*) AS n_train, round(avg(c_acctbal), 4) AS train_mean FROM region f JOIN region g ON g.r_regionkey <> f.r_regionkey
    JOIN nation ON n_regionkey = g.r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY f.r_name""")
def j7_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out region the rows of all others, as total less own, without a join of folds and rows."""
    n = F.broadcast(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows
    each = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"))
    whole = Window.partitionBy(F.lit(0))  # one row per region
    rest, total = F.sum("n").over(whole) - F.col("n"), F.sum("s").over(whole) - F.col("s")
    return each.select(F.col("r_name").alias("held_out"), rest.alias("n_train"), r(total / rest).alias("train_mean"))


# --- filters and gates ---


@query("""WITH m AS (SELECT event_type, median(value) AS center FROM events GROUP BY event_type),
    d AS (SELECT event_type, any_value(center) AS center, median(abs(value - center)) AS mad FROM events JOIN m USING (event_type) GROUP BY event_type)
    SELECT event_type, round(center, 4) AS center, round(mad, 4) AS mad, round(greatest(center - greatest(8, 3 * 1.4826 * mad), 15), 4) AS lower, round(least(center + greatest(8, 3 * 1.4826 * mad), 100), 4) AS upper FROM d""")
def a19_mad_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, median deviation and the band about it."""
    return rounded(quality.mad_bounds(table(spark, sf_dir, "events"), F.col("value"), ["event_type"], low=15.0, high=100.0))


@query(f"""WITH {BEATS}, v AS (SELECT *, {_ewma_sql("CASE WHEN status = 'F' THEN pred_PP END", 0.5, "PARTITION BY session_id, method, status = 'F' ORDER BY beat_index ROWS BETWEEN 60 PRECEDING AND CURRENT ROW")} AS sm FROM beats),
    m AS (SELECT session_id, median(ref_PP) AS c FROM beats GROUP BY session_id), d AS (SELECT session_id, any_value(c) AS c, median(abs(ref_PP - c)) AS mad FROM beats JOIN m USING (session_id) GROUP BY session_id)
    SELECT session_id, method, beat_index, round(CASE WHEN status = 'F' THEN sm END, 4) AS smoothed_PP, 'ok' AS filter_reason
    FROM v JOIN d USING (session_id) WHERE l_tax * 100 <= 6.0000001 AND ref_PP BETWEEN greatest(c - greatest(8, 3 * 1.4826 * mad), 15) AND least(c + greatest(8, 3 * 1.4826 * mad), 100)""")
def f10_filtered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 of W4, F7-F9, A19, J5, Q1, Q2, Q4: smoothing runs over all valid rows, then the gates."""
    rows = beats(spark, sf_dir)
    valid = F.when(F.col("status") == "F", F.col("pred_PP"))
    rows = smooth.smoothed(rows, {"smoothed_PP": valid}, 0.5, ["session_id", "method"], ["beat_index"])
    gated = quality.mad_gated(rows, F.col("ref_PP"), ["session_id"], low=15.0, high=100.0)
    kept = gated.withColumn("near", quality.near_in_time(F.col("l_tax") * 100, ["session_id"], 6.0000001)).where("near and passes")
    return kept.select("session_id", "method", "beat_index", r("smoothed_PP").alias("smoothed_PP"), F.lit("ok").alias("filter_reason"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 AND trim(l_returnflag) = 'N' THEN 1 ELSE 0 END AS strict,
        CASE WHEN lower(trim(replace(coalesce(nullif(l_returnflag, 'R'), ''), '　', ' '))) IN ('', 'n') THEN 1 ELSE 0 END AS lenient FROM lineitem""")
def f1_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict and the lenient rule, side by side."""
    rows = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_linenumber") > 1, 1)
    strict = quality.valid_strict(flag, F.when(F.col("l_returnflag") == "N", " ok ").otherwise(F.col("l_returnflag")))
    lenient = quality.valid_lenient(F.when(F.col("l_returnflag") == "N", "　OK ").otherwise(F.nullif("l_returnflag", F.lit("R"))))
    return rows.select("l_orderkey", "l_linenumber", strict.cast("int").alias("strict"), lenient.cast("int").alias("lenient"))


@query("""WITH p AS (SELECT l_suppkey, l_linestatus, l_quantity FROM lineitem WHERE l_suppkey IN (1, 2, 3, 5, 8) AND l_returnflag IN ('A', 'R') AND l_quantity IS NOT NULL),
    k AS (SELECT l_suppkey, count(*) AS c FROM p GROUP BY l_suppkey HAVING count(*) >= 40) SELECT p.l_suppkey, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity FROM p JOIN k USING (l_suppkey) GROUP BY ALL""")
def f12_listed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List predicates reach the scan; groups need 40 rows."""
    rows = frames.available(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linestatus", "l_returnflag", "l_quantity", "no_such_column"])
    rows = rows.where(F.col("l_suppkey").isin(1, 2, 3, 5, 8) & F.col("l_returnflag").isin("A", "R")).dropna(subset=["l_quantity"])
    return quality.supported(rows, ["l_suppkey"], 40).groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean_quantity"))


@query("""WITH p AS (SELECT l_suppkey, l_returnflag, l_quantity FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL AND nullif(l_tax, 0) IS NOT NULL AND l_quantity IS NOT NULL),
    k AS (SELECT l_suppkey, l_returnflag FROM p GROUP BY ALL HAVING count(*) >= 160) SELECT l_suppkey, l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity FROM p JOIN k USING (l_suppkey, l_returnflag) GROUP BY ALL""")
def f16_supported_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which all columns are there, in groups that have 160 of them."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"))
    rows = quality.supported(rows.dropna(subset=["l_quantity", "d", "t"]), ["l_suppkey", "l_returnflag"], 160)
    return rows.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean_quantity"))


# --- windows and features ---


@query(f"""WITH {BEATS} SELECT session_id, method, beat_index, round({_ewma_sql('ref_MAP', 0.3, 'PARTITION BY session_id, method ORDER BY beat_index ROWS BETWEEN 117 PRECEDING AND CURRENT ROW')}, 4) AS smoothed_MAP,
    round(ref_PP - {_ewma_sql('ref_PP', 0.28, 'PARTITION BY session_id, method ORDER BY beat_index ROWS BETWEEN 127 PRECEDING AND CURRENT ROW')}, 4) AS highpass_PP FROM beats""")
def w4_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential smoothing and what it leaves."""
    k, o = ["session_id", "method"], ["beat_index"]
    rows = smooth.smoothed(beats(spark, sf_dir), {"smoothed_MAP": F.col("ref_MAP")}, 0.3, k, o)
    return rounded(smooth.detrended(rows, {"highpass_PP": F.col("ref_PP")}, 0.28, k, o).select(*k, *o, "smoothed_MAP", "highpass_PP"))


@query(f"""WITH {BEATS}, a AS (SELECT *, coalesce(pred_PP - lag(pred_PP) OVER w, 0) AS x_delta, coalesce(pred_MAP - lag(pred_MAP) OVER w, 0) AS c_delta FROM beats WINDOW w AS (PARTITION BY session_id ORDER BY beat_index))
    SELECT session_id, beat_index, round(pred_PP - median(pred_PP) OVER (PARTITION BY session_id), 4) AS x_centered, round(x_delta, 4) AS x_delta,
        round(coalesce(x_delta - lag(x_delta) OVER (PARTITION BY session_id ORDER BY beat_index), 0), 4) AS x_accel, round(pred_MAP - median(pred_MAP) OVER (PARTITION BY session_id), 4) AS c_centered, round(c_delta, 4) AS c_delta FROM a""")
def w3_design_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dynamic features."""
    d = features.design(beats(spark, sf_dir), "pred_PP", "pred_MAP", ["session_id"], ["beat_index"])
    return rounded(d.select("session_id", "beat_index", "x_centered", "x_delta", "x_accel", "c_centered", "c_delta"))


@query(f"""WITH {BEATS}, g AS (SELECT session_id, beat_index, ref_MAP, median(ref_MAP) OVER (PARTITION BY session_id) AS a, coalesce(lag(ref_MAP, 2) OVER w, ref_MAP) AS back, coalesce(lead(ref_MAP, 3) OVER w, ref_MAP) AS ahead FROM beats WINDOW w AS (PARTITION BY session_id ORDER BY beat_index))
    SELECT session_id, beat_index, round(back, 4) AS back, round(ahead, 4) AS ahead, round(a - 0.85 * (back - a), 4) AS turned FROM g""")
def w6_shift_and_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts with fallback, turned about the median."""
    k, o, x = ["session_id"], ["beat_index"], F.col("ref_MAP")
    return beats(spark, sf_dir).select(*k, *o, r(features.shifted(x, 2, k, o)).alias("back"), r(features.shifted(x, -3, k, o)).alias("ahead"), r(features.transformed(x, 2, -1.0, 0.85, k, o)).alias("turned"))


@query(f"""WITH {BEATS}, f AS (SELECT * FROM beats WHERE beat_index <= 30)
    SELECT session_id, count(*) AS n, round(median(l_quantity), 4) AS q_median, round(stddev_pop(l_quantity), 4) AS q_std, round(quantile_cont(l_quantity, 0.1), 4) AS q_p10, round(quantile_cont(l_quantity, 0.9), 4) AS q_p90,
        round(arg_max(l_quantity, beat_index) - arg_min(l_quantity, beat_index), 4) AS q_delta, round(median(ref_PP), 4) AS pp_anchor FROM f GROUP BY session_id""")
def a22_initial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each session's first 30 beats."""
    s = baseline.initial_summary(beats(spark, sf_dir), ["l_quantity"], ["ref_PP"], "session_id", "beat_index")
    q = {"q_" + x: f"l_quantity_{x}" for x in baseline.STATISTICS}
    return rounded(s.select("session_id", "n", *[F.col(c).alias(k) for k, c in q.items()], F.col("ref_PP_anchor").alias("pp_anchor")))


@query(f"""WITH {BEATS}, m AS (SELECT session_id, median(ref_PP) AS anchor FROM beats WHERE beat_index <= 30 GROUP BY session_id)
    SELECT session_id, beat_index, round(100 + 0.25 * (ref_PP - anchor), 4) AS blended FROM beats JOIN m USING (session_id)""")
def w12_prefix_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline plus part of the movement from the prefix's median."""
    return beats(spark, sf_dir).select("session_id", "beat_index", r(baseline.blended(F.lit(100.0), F.col("ref_PP"), 0.25, ["session_id"], ["beat_index"])).alias("blended"))


@query(f"""WITH {BEATS}, d AS (SELECT session_id, beat_index, ref_MAP - lag(ref_MAP) OVER w AS r, pred_MAP - lag(pred_MAP) OVER w AS p FROM beats WINDOW w AS (PARTITION BY session_id ORDER BY beat_index))
    SELECT session_id, count(r) AS n, round({CORR.format(a='p', b='r')}, 4) AS delta_corr FROM d WHERE beat_index <= 8 GROUP BY session_id""")
def w13_prefix_delta_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of differences within the first eight rows."""
    k, o = ["session_id"], ["beat_index"]
    rows = beats(spark, sf_dir)
    rows = rows.select(*k, *o, features.difference(F.col("ref_MAP"), k, o).alias("r"), features.difference(F.col("pred_MAP"), k, o).alias("p")).where("beat_index <= 8")
    return rows.groupBy(*k).agg(F.count("r").alias("n"), r(statistics.pearson(F.col("p"), F.col("r"))).alias("delta_corr"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_discount, 0), 4) AS q_per_d, round(l_tax / nullif(l_discount, 0), 4) AS t_per_d, round(l_quantity * l_tax, 4) AS q_by_t, round(l_quantity - l_linenumber, 4) AS gap, round(l_quantity * l_quantity, 4) AS q_square FROM lineitem""")
def p16_ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences, guarded ratios, products, squares."""
    rows = features.ratios(table(spark, sf_dir, "lineitem"), {"q_per_d": ("l_quantity", "l_discount"), "t_per_d": ("l_tax", "l_discount")})
    q = F.col("l_quantity")
    return rounded(rows.select("l_orderkey", "l_linenumber", "q_per_d", "t_per_d", (q * F.col("l_tax")).alias("q_by_t"), (q - F.col("l_linenumber")).alias("gap"), F.pow(q, 2).alias("q_square")))


# --- projections and scalars ---


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 500 AS s, l_quantity * 4 AS d FROM lineitem), c AS (SELECT *, greatest(s, d + 20) AS s2 FROM b)
    SELECT l_orderkey, l_linenumber, round(least(greatest(s2, 60), 200), 4) AS sbp, round(least(greatest(d, 40), 150), 4) AS dbp, round((s + 2 * d) / 3, 4) AS map_, round(s - d, 4) AS pp,
        round((s + 2 * d) / 3 - (s - d) / 3, 4) AS dbp_back, CASE WHEN s BETWEEN 60 AND 200 THEN 0 ELSE 1 END AS replaced, round(CASE WHEN s BETWEEN 60 AND 200 THEN s ELSE 120 END, 4) AS anchor FROM c""")
def p5_pressure_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities, clamps and anchors."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 500).alias("s"), (F.col("l_quantity") * 4).alias("d"))
    s, d = F.col("s"), F.col("d")
    sbp, dbp = scalar.plausible(s, d)
    m, p = scalar.mean_pressure(s, d), scalar.pulse_pressure(s, d)
    anchor, swapped = scalar.anchored(s, F.lit(120.0), 60.0, 200.0)
    return rounded(rows.select("l_orderkey", "l_linenumber", sbp.alias("sbp"), dbp.alias("dbp"), m.alias("map_"), p.alias("pp"), scalar.diastolic(m, p).alias("dbp_back"), swapped.cast("int").alias("replaced"), anchor.alias("anchor")))


@query("""SELECT l_orderkey, l_linenumber, round(50 + 0.4 * l_quantity - 30 * l_discount + 12 * l_tax, 4) AS prediction, round(0.4 * 0.9 * l_quantity, 4) AS quantity_term, round(-30 * l_discount, 4) AS discount_term, round(12 * l_tax, 4) AS tax_term FROM lineitem""")
def p9_linear_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model, its terms, and a scaled term."""
    coef, names, labels = [50.0, 0.4, -30.0, 12.0], ["l_quantity", "l_discount", "l_tax"], ["quantity", "discount", "tax"]
    t = ridge.terms(ridge.scaled(coef, labels, {"quantity": 0.9}), names, labels)
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ridge.linear(coef, names).alias("prediction"), *[t[x].alias(f"{x}_term") for x in labels]))


@query("""SELECT event_id, user_id AS m_user_id, event_type AS m_event_type, value AS m_value, value AS m_value_export, CASE WHEN event_type <> 'error' THEN value END AS m_masked, CASE WHEN event_type <> 'error' THEN value END AS m_masked_smoothed FROM events""")
def p1_renamed_and_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes, backups, masks."""
    rows = frames.prefixed(table(spark, sf_dir, "events"), "m_", ["event_id"])
    rows = frames.backed_up(frames.with_prefix(rows, ["m_"], ["event_id"]).drop("m_ts", "m_props"), ["m_value"])
    rows = frames.replaced(rows, {"m_masked": F.col("m_value"), "m_value": F.lit(None)}, preserve=True)
    return frames.masked(rows, ["m_masked"], F.col("m_event_type") != "error", ["smoothed"])


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k_text, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, printf('%.3f', value) AS text3, CASE WHEN event_type LIKE 'c%' THEN 1 ELSE 0 END AS starts_c, upper(substr(event_type, 1, 3)) AS part FROM events""")
def x5_json_regex_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, patterns, time stamps, fixed decimals."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"), scalar.integer(F.regexp_extract("props", '"k": *([0-9]+)', 1)).alias("k_text"),
        F.unix_millis("at").alias("ms"), scalar.iso_from_epoch_ms(F.unix_millis("at")).alias("iso"), scalar.fixed(F.col("value"), 3).alias("text3"),
        F.startswith("event_type", F.lit("c")).cast("int").alias("starts_c"), F.upper(F.substring("event_type", 1, 3)).alias("part"),
    )


@query("""SELECT doc_id, length(trim(text)) AS n_trimmed, lower(trim(substr(text, 1, 12))) AS head, CASE WHEN lower(trim(replace(coalesce(lang, ''), '　', ' '))) IN ('', 'en') THEN 1 ELSE 0 END AS english, len(string_split(text, ' ')) AS n_parts FROM documents""")
def x2_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules on documents."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(F.trim(t)).cast("long").alias("n_trimmed"), F.lower(F.trim(F.substring(t, 1, 12))).alias("head"),
        scalar.tidy(F.col("lang")).isin("", "en").cast("int").alias("english"), F.size(F.split(t, " ", -1)).cast("long").alias("n_parts"),
    )


# --- sets, sorts, top-k ---


@query("""(SELECT DISTINCT c_nationkey AS nation, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)
    UNION ALL (SELECT DISTINCT c_nationkey, 'customers only' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier))""")
def u3_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct, intersect, except, union all."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers only")))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM k WHERE place <= 3""")
def o3_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each customer."""
    o = features.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)
    return o.select("o_custkey", "o_orderkey", r("o_totalprice", 2).alias("o_totalprice"))


@query("""SELECT user_id, arg_min(event_id, (abs(value - 50), event_id)) AS nearest_event, min(abs(value - 50)) AS distance FROM events GROUP BY user_id""")
def o6_arg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event nearest a value, per user, in one aggregation."""
    d = F.abs(F.col("value") - 50)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(d.alias("d"), "event_id")).alias("nearest_event"), F.min(d).alias("distance"))


@query(f"""WITH {PAIRS}, w AS (SELECT session_id, target, CAST(floor(elapsed_s / 20.0) AS BIGINT) AS window_index, avg(ref) AS ref FROM pairs WHERE target = 'SBP' GROUP BY ALL),
    c AS (SELECT session_id, window_index, ref - median(ref) OVER (PARTITION BY session_id) AS rc FROM w), a AS (SELECT session_id, count(DISTINCT window_index) AS n_windows, stddev_samp(rc) AS spread FROM c GROUP BY session_id)
    SELECT session_id, n_windows, round(spread, 4) AS spread FROM a ORDER BY n_windows DESC, spread DESC, session_id LIMIT 1""")
def a25_representative_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session to show."""
    w = windows.tumbling(_pairs(spark, sf_dir).where("target = 'SBP'"), ["session_id", "target"], "elapsed_s", [20], ["ref"])
    return rounded(metrics.representative(w.withColumn("ref_centered", features.centered(F.col("ref"), ["session_id"])), "session_id"))


@query(f"""WITH {BEATS}, f AS (SELECT session_id, ref_PP, 'l_quantity' AS feature, l_quantity AS value FROM beats UNION ALL SELECT session_id, ref_PP, 'l_discount', l_discount FROM beats UNION ALL SELECT session_id, ref_PP, 'l_tax', l_tax FROM beats)
    SELECT session_id, feature, count(*) AS n, round({CORR.format(a='value', b='ref_PP')}, 4) AS corr, round({CORR.format(a='value', b='ref_PP')}, 4) AS centered_corr, round(stddev_pop(value), 4) AS std FROM f GROUP BY session_id, feature HAVING count(*) >= 3""")
def a21_feature_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and centred correlations of features with the reference."""
    return rounded(metrics.screening(beats(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "ref_PP", ["session_id"]))


# --- models ---


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s_q, round(sum(l_discount), 2) AS s_d, round(sum(l_quantity * l_quantity), 2) AS s_qq, round(sum(l_quantity * l_discount), 2) AS s_qd,
    round(sum(l_quantity * l_extendedprice), 1) AS s_qy FROM lineitem GROUP BY l_returnflag""")
def a27_gram_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums that ridge models are solved from."""
    g = ridge.gram(table(spark, sf_dir, "lineitem"), [F.col("l_quantity"), F.col("l_discount")], F.col("l_extendedprice"), ["l_returnflag"])
    at = {"s_q": 1, "s_d": 2, "s_qq": 4, "s_qd": 5}
    return g.select("l_returnflag", "n", *[r(F.col("sums")[k], 2).alias(c) for c, k in at.items()], r(F.col("sums")[6], 1).alias("s_qy"))


_ONE = """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx, covar_pop(l_quantity, l_extendedprice) AS cxy FROM lineitem)"""


@query(_ONE + """, b AS (SELECT cxy * n / (n * vx + 1.0 * vx) AS slope, * FROM s)
    SELECT l_orderkey, l_linenumber, round(my + slope * (l_quantity - mx), 2) AS prediction FROM lineitem, b""")
def m1_ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standardised ridge model (alpha 1) and its predictions; with one feature SQL can solve it."""
    rows = table(spark, sf_dir, "lineitem")
    coef = ridge.fit(rows, ["l_quantity"], "l_extendedprice", 1.0)
    return rows.select("l_orderkey", "l_linenumber", r(ridge.linear(coef, ["l_quantity"]), 2).alias("prediction"))


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem GROUP BY l_suppkey),
    t AS (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM s),
    f AS (SELECT s.l_suppkey AS k, t.n - s.n AS n, t.x - s.x AS x, t.y - s.y AS y, t.xx - s.xx AS xx, t.xy - s.xy AS xy FROM s, t),
    c AS (SELECT k, x / n AS mx, y / n AS my, (xy - x * y / n) / ((xx - x * x / n) * (1 + 1.0 / n)) AS slope FROM f)
    SELECT l_suppkey, l_orderkey, l_linenumber, round(my + slope * (l_quantity - mx), 1) AS prediction FROM lineitem JOIN c ON k = l_suppkey""")
def m12_leave_one_session_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session predicted by the model of all others, from one pass of sums."""
    rows = table(spark, sf_dir, "lineitem")
    folds = ridge.fit_folds(rows, ["l_quantity"], "l_extendedprice", "l_suppkey", 1.0)
    return ridge.replay(rows, folds, ["l_quantity"], "l_suppkey", "prediction").select("l_suppkey", "l_orderkey", "l_linenumber", r("prediction", 1).alias("prediction"))


def _slope(x: str, y: str) -> str:
    """A standardised ridge slope (alpha 1) over a group."""
    return f"(count(*) * covar_pop({x}, {y}) / ((count(*) + 1) * var_pop({x})))"


@query(f"""WITH {BEATS}, y AS (SELECT *, unnest(['MAP', 'PP']) AS target, unnest([ref_MAP, ref_PP]) AS y FROM beats),
    a AS (SELECT target, {_slope('l_quantity', 'y')} AS s1, avg(y) - {_slope('l_quantity', 'y')} * avg(l_quantity) AS i1 FROM y WHERE method = 'N' GROUP BY target),
    d AS (SELECT y.target, y.l_discount AS x, y.y - i1 - s1 * l_quantity AS y FROM y JOIN a USING (target) WHERE method = 'R'),
    b AS (SELECT target, {_slope('x', 'y')} AS s2, avg(y) - {_slope('x', 'y')} * avg(x) AS i2 FROM d GROUP BY target),
    o AS (SELECT target, {_slope('l_tax', 'y')} AS s3, avg(y) - {_slope('l_tax', 'y')} * avg(l_tax) AS i3 FROM y WHERE method = 'A' GROUP BY target)
    SELECT 'refined' AS method, target, unnest(['intercept', 'l_quantity', 'l_discount']) AS term, round(unnest([i1 + i2, s1, s2]), 4) AS value FROM a JOIN b USING (target)
    UNION ALL SELECT 'plain', target, unnest(['intercept', 'l_quantity']), round(unnest([i1, s1]), 4) FROM a
    UNION ALL SELECT 'other', target, unnest(['intercept', 'l_tax']), round(unnest([i3, s3]), 4) FROM o""")
def m5_trained_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of methods, one of them in two stages, trained on their own samples, as a coefficient table."""
    df = beats(spark, sf_dir).withColumns({"valid": F.lit(1), "reason": F.lit(" ok ")})
    specs = [training.Spec("plain", ("l_quantity",)), training.Spec("refined", ("l_quantity",), "plain", ("l_discount",)), training.Spec("other", ("l_tax",))]
    of = {"plain": "N", "refined": "R", "other": "A"}
    rows = {s.name: training.samples(df.where(F.col("method") == of[s.name]).drop("method"), s, "valid", "reason") for s in specs}
    return rounded(ridge.coefficient_table(spark, training.train(rows, specs), {s.name: s.all() for s in specs}))


@query()
def m6_adaptive_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and change models of sessions, replayed."""
    rows = beats(spark, sf_dir)
    model = baseline.train(rows, ["l_quantity", "l_discount"], "pred_PP", "session_id", "beat_index")
    return rounded(baseline.replay(rows, model, "session_id", "beat_index", "pp", 0.8, 15.0, 100.0).select("session_id", "beat_index", "pp", "pp_baseline", F.col("pp_replaced").cast("int").alias("replaced")))


@query()
def m13_tracking_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each method by itself, the centred course that other sessions' dynamics predict, blended in."""
    out = projection.projected(kept(spark, sf_dir), {"A": {"MAP": 0.9, "PP": 0.9}, "R": {"MAP": 1.1, "PP": 1.1}, "N": {"MAP": 0.2}}, "session_id", ["beat_index"])
    return rounded(out.select("session_id", "method", "beat_index", "pred_MAP", "pred_PP", "pred_SBP", "pred_DBP"))


@query()
def m14_pulse_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corrected pulse pressure, clipped and smoothed."""
    out, _ = projection.candidates(beats(spark, sf_dir), [], ["l_quantity", "l_discount", "l_tax"], "ref_PP", "pred_PP", "session_id", ["beat_index"])
    return rounded(out.select("session_id", "beat_index", F.col("candidate_a").alias("candidate")))


@query(f"""WITH {BEATS}, f AS (SELECT session_id, ref_PP AS y, 'l_quantity' AS feature, l_quantity AS x FROM beats UNION ALL SELECT session_id, ref_PP, 'l_discount', l_discount FROM beats UNION ALL SELECT session_id, ref_PP, 'l_tax', l_tax FROM beats),
    s AS (SELECT session_id, feature, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM f GROUP BY ALL),
    h AS (SELECT a.session_id AS held_out, b.feature, sum(b.n) AS n, sum(b.x) AS x, sum(b.y) AS y, sum(b.xx) AS xx, sum(b.yy) AS yy, sum(b.xy) AS xy FROM (SELECT DISTINCT session_id FROM beats) a JOIN s b ON a.session_id <> b.session_id GROUP BY ALL),
    k AS (SELECT held_out, feature, abs((n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y))) AS strength FROM h)
    SELECT held_out, CAST(row_number() OVER (PARTITION BY held_out ORDER BY strength DESC, feature DESC) AS INTEGER) AS place, feature, round(strength, 4) AS strength FROM k QUALIFY place <= 2""")
def o4_leading_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's strongest features."""
    return rounded(projection.leading_features(beats(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "ref_PP", "session_id", 2))


# --- streams ---


@query("""SELECT event_type, CAST(epoch_us(ts) // 3600000000 * 3600000 AS BIGINT) AS window_ms, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def r6_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows over a stream, to its end."""
    return match.hourly_windows(spark, f"{sf_dir}/events.parquet").select("event_type", "window_ms", "n", r("total", 2).alias("total"))


# --- entry points ---


@query()
def m8_shared_baseline_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One baseline model from the discovered columns of one method's rows, replayed for all methods, with their dynamics blended in."""
    df = kept(spark, sf_dir).withColumn("l_empty", F.lit(None).cast("double"))  # read by each step of the training
    rows = {m: df.where(F.col("method") == m) for m in ("A", "N", "R")}
    models = training.train_baselines(rows, ["l_"], "session_id", "beat_index", "ref_PP", shared="A", leave=["l_extendedprice"])
    each = [baseline.replay(rows[m], models[m], "session_id", "beat_index", "pp", 0.8, 15.0, 100.0) for m in rows]
    # blended before they are put together, while they lie by session
    each = [training.blended_series(x, F.col("pp_baseline"), F.col("pred_PP"), 0.7, ["method", "session_id"], ["beat_index"]) for x in each]
    out = each[0].unionByName(each[1]).unionByName(each[2])
    return rounded(out.select("session_id", "method", "beat_index", "pp_baseline", "blend", "blend_smoothed"))


_W = "PARTITION BY session_id, method, window_seconds, target"


_OWN = "PARTITION BY session_id, method ORDER BY beat_index"


@query(f"""WITH {BEATS}, v AS (SELECT *, {_ewma_sql('pred_MAP', 0.3, _OWN + ' ROWS BETWEEN 117 PRECEDING AND CURRENT ROW')} AS sm, {_ewma_sql('pred_PP', 0.5, _OWN + ' ROWS BETWEEN 60 PRECEDING AND CURRENT ROW')} AS sp FROM beats WHERE status = 'F'),
    m AS (SELECT session_id, median(ref_PP) AS c FROM beats GROUP BY session_id), d AS (SELECT session_id, any_value(c) AS c, median(abs(ref_PP - c)) AS mad FROM beats JOIN m USING (session_id) GROUP BY session_id),
    k AS (SELECT v.* FROM v JOIN d USING (session_id) WHERE l_tax * 5000 <= 350 AND ref_PP BETWEEN greatest(c - greatest(8, 3 * 1.4826 * mad), 15) AND least(c + greatest(8, 3 * 1.4826 * mad), 100)),
    p AS ({' UNION ALL '.join(f"SELECT session_id, method, '{s}' AS series, '{t}' AS target, ref_{t} AS ref, {x} AS pred FROM k" for s, xs in (('raw', {t: f'pred_{t}' for t in TARGETS}), ('smoothed', {'SBP': 'sm - sp / 3 + sp', 'DBP': 'sm - sp / 3', 'MAP': 'sm', 'PP': 'sp'})) for t, x in xs.items())}),
    c AS (SELECT *, ref - median(ref) OVER w AS rc, pred - median(pred) OVER w AS pc FROM p WINDOW w AS (PARTITION BY session_id, method, series, target))
    SELECT session_id, method, series, target, count(*) AS n, round(avg(abs(pred - ref)), 4) AS mae, round(sqrt(avg((pred - ref) ** 2)), 4) AS rmse, round({CORR.format(a='pred', b='ref')}, 4) AS corr,
        round(CASE WHEN sum(rc * rc) = 0 THEN NULL ELSE sum(rc * pc) / sum(rc * rc) END, 4) AS tracking_gain FROM c GROUP BY ALL""")
def e1_session_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged beats to measures per session, method, series and target."""
    from . import sessions

    rows = beats(spark, sf_dir).withColumns({"valid": F.col("status") == "F", "artifact_flag": F.lit(0), "abs_time_delta_ms": F.col("l_tax") * 5000})
    return rounded(sessions.evaluate(rows)["metrics"].select("session_id", "method", "series", "target", "n", "mae", "rmse", "corr", "tracking_gain"))


@query(f"""WITH {BEATS}, w AS (SELECT *, unnest([5.0, 10.0, 20.0]) AS window_seconds FROM beats),
    g AS (SELECT session_id, method, window_seconds, floor(elapsed_s / window_seconds) AS i, {', '.join(f'avg({s}_{t}) AS {s}_{t}' for s in ('ref', 'pred') for t in TARGETS)} FROM w GROUP BY ALL),
    p AS ({' UNION ALL '.join(f"SELECT session_id, method, window_seconds, i, '{t}' AS target, ref_{t} AS ref, pred_{t} AS pred FROM g" for t in TARGETS)}),
    c AS (SELECT *, pred - median(pred) OVER ({_W}) - (ref - median(ref) OVER ({_W})) AS ce FROM p),
    m AS (SELECT session_id, method, window_seconds, target, avg(abs(pred - ref)) AS mae, avg(abs(ce)) AS centered_mae, {CORR.format(a='pred', b='ref')} AS corr FROM c GROUP BY ALL)
    SELECT CAST(window_seconds AS DOUBLE) AS window_seconds, method, target, count(DISTINCT session_id) AS n_sessions, round(avg(mae), 4) AS mean_mae, round(median(centered_mae), 4) AS median_centered_mae, round(avg(corr), 4) AS mean_corr FROM m GROUP BY ALL""")
def e2_tracking_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three widths to summaries over sessions."""
    from . import sessions

    return rounded(sessions.track(beats(spark, sf_dir))["summary"].select("window_seconds", "method", "target", "n_sessions", "mean_mae", "median_centered_mae", "mean_corr"))


@query()
def e3_coefficient_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models per method, in sample and held out, scored per session and over all."""
    from . import sessions

    found = sessions.search(beats(spark, sf_dir), {"A": ["l_quantity"], "N": ["l_tax", "l_discount"], "R": ["l_quantity", "l_discount"]})
    return rounded(found["summary"])


@query("""WITH p AS (SELECT l.event_id, l.user_id, rr.event_id AS ref_id, epoch_us(l.ts) - epoch_us(rr.ts) AS d FROM events l JOIN events rr
        ON l.user_id = rr.user_id AND l.event_type = 'click' AND rr.event_type = 'view' AND abs(epoch_us(l.ts) - epoch_us(rr.ts)) <= 7200000000)
    SELECT event_id, arg_min(ref_id, (abs(d), ref_id)) AS ref_id, round(min(abs(d)) / 1000.0, 3) AS distance_ms FROM p GROUP BY event_id""")
def r4_stream_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined within two hours; the nearest of each click."""
    e = match.event_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "event_type")
    sides = [e.where(F.col("event_type") == t).drop("event_type") for t in ("click", "view")]
    pairs = match.drained(match.nearest_within(*sides, "key", "2 hours"))
    d = F.abs("delta_ms")
    return pairs.groupBy(F.col("id").alias("event_id")).agg(F.min_by("ref_id", F.struct(d.alias("d"), "ref_id")).alias("ref_id"), r(F.min(d), 3).alias("distance_ms"))


@query(f"""SELECT user_id, event_id, round({_ewma_sql('value', 0.3, 'PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 117 PRECEDING AND CURRENT ROW')}, 4) AS smoothed FROM events""")
def r5_stream_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing as the state of a stream, equal to the batch result."""
    e = match.event_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("x"))
    out = match.drained(match.smoothed_now(e, 0.3))
    return out.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), r("smoothed").alias("smoothed"))


@query("""SELECT count(*) AS n_rows, count(DISTINCT n_regionkey) AS n_groups, CAST(min(n_nationkey) AS BIGINT) AS first_key, CAST(max(n_nationkey) AS BIGINT) AS last_key, 'n_name,n_nationkey' AS finite_or_text FROM nation""")
def p20_column_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns chosen by what they hold, and plain counts."""
    n = table(spark, sf_dir, "nation").withColumn("empty", F.lit(None).cast("double"))
    found = frames.with_finite_values(n, ["n_nationkey", "empty", "n_name"])
    names = ",".join(sorted(dict.fromkeys([*found, "n_name"])))
    return n.agg(F.count("*").alias("n_rows"), F.count_distinct("n_regionkey").alias("n_groups"), F.min("n_nationkey").cast("long").alias("first_key"), F.max("n_nationkey").cast("long").alias("last_key")).withColumn("finite_or_text", F.lit(names))
