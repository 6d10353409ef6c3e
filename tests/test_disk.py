"""What queries over beats send through shuffles: rows by session, not rows by target, series, lag or model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_core import plain_ewma
from trackspark.operators import align, evaluation, folds, smooth
from trackspark.plans import beats as plan
from trackspark.plans import evaluations, feeds, models, more, queries, sessions  # noqa: F401  they register queries
from trackspark.shared import cut

SF = "/root/testdata/sf0.001"


def rows_shuffled(spark, run):
    """Rows written to shuffles by what run does, and what run returns."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before, out = total(), run()
    return total() - before, out


def count(spark):
    return plan.table(spark, SF, "lineitem").count()


def test_beats_are_shuffled_once(spark):
    n, rows = rows_shuffled(spark, lambda: queries.QUERIES["q1_tracking_metrics"](spark, SF).collect())
    assert rows and n == count(spark)


@pytest.mark.parametrize("query", ["a15_session_style", "q4_pooled_scopes", "a12_method_table"])
def test_tables_shuffle_rows_by_session(spark, query):
    # what comes on top are rows per session, method, series and target, and values near pooled medians
    n, rows = rows_shuffled(spark, lambda: queries.QUERIES[query](spark, SF).collect())
    groups = len({(r[0], r["method"]) for r in rows})
    assert n < count(spark) + 40 * groups


def test_pooled_rows_hold_sessions_and_methods_without_a_name(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(200):
        s, d, p, q = (float(x) for x in r.normal([120, 75, 122, 74], 9))
        rows.append((None if k % 4 == 3 else k % 4, None if k % 5 == 0 else "A", k, s, d, (s + 2 * d) / 3, s - d, None if k % 7 == 0 else p, q, (p + 2 * q) / 3, p - q))
    names = ["session_id", "method", "beat_index", *[f"{x}_{t}" for x in ("ref", "pred") for t in ("SBP", "DBP", "MAP", "PP")]]
    df = spark.createDataFrame(rows, f"session_id long, method string, beat_index long, {', '.join(f'{c} double' for c in names[3:])}").repartition(3)
    out = {(o.method, o.target): o for o in evaluation.measured(df, {"raw": {}}, ["beat_index"]).where("session_id = 'ALL'").collect()}
    assert set(out) == {(m, t) for m in (None, "A") for t in ("SBP", "DBP", "MAP", "PP")}
    for (m, t), o in out.items():
        own = sorted((x for x in rows if x[1] == m), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
        kept = [(x[names.index(f"ref_{t}")], x[names.index(f"pred_{t}")]) for x in own if x[names.index(f"pred_{t}")] is not None]
        ref, pred = np.array(kept).T
        a, b = ref - np.median(ref), pred - np.median(pred)
        da, db = np.diff(a), np.diff(b)
        whole = [x[9] - x[5] for x in own if x[7] is not None]
        want = dict(
            n=len(ref), mae=abs(pred - ref).mean(), rmse=((pred - ref) ** 2).mean() ** 0.5, corr=np.corrcoef(ref, pred)[0, 1], signed_bias=(pred - ref).mean(), centered_mae=abs(b - a).mean(), centered_rmse=((b - a) ** 2).mean() ** 0.5,
            centered_corr=np.corrcoef(a, b)[0, 1], tracking_gain=(a * b).sum() / (a * a).sum(), amplitude_ratio=b.std() / a.std(), direction_agreement=(np.sign(da) == np.sign(db)).mean(), delta_mae=abs(db - da).mean(), map_mae=np.abs(whole).mean(), map_signed_bias=np.mean(whole),
        )
        assert all(o[k] == pytest.approx(v) for k, v in want.items()), (m, t)


def test_constant_courses_have_no_pooled_correlation(spark):
    df = spark.createDataFrame([(k % 3, "A", k, 120.1, 70.3, 86.9, 49.8, 121.7, 70.3 + k, 87.3, 51.4) for k in range(30)], f"session_id long, method string, beat_index long, {', '.join(f'{x}_{t} double' for x in ('ref', 'pred') for t in ('SBP', 'DBP', 'MAP', 'PP'))}")
    out = evaluation.measured(df, {"raw": {}}, ["beat_index"]).collect()
    assert len(out) == 16 and all(o.corr is None and o.tracking_gain is None and o.amplitude_ratio is None and o.direction_agreement is None and o.inversion_like == 0 for o in out)


def test_experimental_measures_shuffle_no_rows(spark):
    n = count(spark)
    names = ["l_quantity", "l_discount"], ["l_quantity", "l_discount", "l_tax"], "N"
    rows = cut(plan.beats(spark, SF), "session_id")
    sent, out = rows_shuffled(spark, lambda: sessions.experimental_measures(rows, *names).toPandas())
    # moments, summaries and models of sessions only: 10 sessions with up to three methods
    assert sent < n
    whole = sessions.experimental_summary(sessions.experimental(rows, *names)).toPandas()
    keys = ["session_id", "method", "series", "kind", "target"]
    a, b = (x.sort_values(keys).reset_index(drop=True)[sorted(whole.columns)] for x in (out, whole))
    assert sorted(out.columns) == sorted(whole.columns) and len(a) == len(b) and (a[keys] == b[keys]).all().all()
    for c in set(a.columns) - set(keys):
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, equal_nan=True), c


def test_grid_alignment_shuffles_beats_once(spark):
    # besides, a group's choice: three methods of each session, twice
    n, rows = rows_shuffled(spark, lambda: queries.QUERIES["m15_grid_alignment"](spark, SF).collect())
    assert rows and n <= count(spark) + 20 * len({x.session_id for x in rows})


def test_groups_without_a_name_are_aligned(spark):
    r = np.random.default_rng(3)
    rows = [(s, m, k, *map(float, r.normal(90, 9, 8))) for s in (None, 1) for m in (None, "A") for k in range(20)]
    names = [f"{x}_{t}" for x in ("ref", "pred") for t in ("MAP", "PP", "SBP", "DBP")]
    df = spark.createDataFrame(rows, f"s long, method string, k long, {', '.join(f'{c} double' for c in names)}").repartition(3)
    named = df.withColumns({"s": F.coalesce("s", F.lit(0)), "method": F.coalesce("method", F.lit("B"))})
    a, b = (align.aligned(x, ["s", "method"], "k", "method").toPandas() for x in (df, named))
    a = a.fillna({"s": 0, "method": "B"}).sort_values(["s", "method", "k"]).drop(columns=["s", "method"])
    b = b.sort_values(["s", "method", "k"]).drop(columns=["s", "method"])
    assert len(a) == 80 and np.array_equal(a.to_numpy(float), b.to_numpy(float)) and a.map_lag.nunique() > 1


def test_models_find_sessions_and_methods_without_a_name(spark):
    keys = [(None, "A"), (None, None), (1, "A"), (1, None), (2, "B")]
    table = spark.createDataFrame([(s, m, t, float(k)) for k, (s, m) in enumerate(keys) for t in "xy"], "s long, m string, t string, v double")
    rows = spark.createDataFrame([*keys, (3, "A"), (2, "A")], "s long, m string").repartition(3)
    out = folds.looked_up(rows, table, "s", {"x": {"m": F.col("m"), "t": F.lit("x")}, "z": {"m": F.col("m"), "t": F.lit("z")}}).collect()
    assert len(out) == 7 and out[0].asDict().keys() == {"s", "m", "x", "z"}
    for o in out:
        assert o.z is None and (o.x is None if (o.s, o.m) not in keys else o.x.v == keys.index((o.s, o.m)))


def test_whole_columns_are_smoothed_together(spark):
    r = np.random.default_rng(1)
    rows = [(k % 2, k, *map(float, r.normal(size=2))) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, k long, x double, y double").repartition(3)
    out = smooth.smoothed(df, {"sx": F.col("x"), "sy": F.col("y")}, 0.35, ["g"], ["k"], whole=True).toPandas()
    assert list(out.columns) == ["g", "k", "x", "y", "sx", "sy"]
    for _, own in out.sort_values("k").groupby("g"):
        assert np.allclose(own.sx, plain_ewma(own.x.tolist(), 0.35)) and np.allclose(own.sy, plain_ewma(own.y.tolist(), 0.35))


@pytest.mark.parametrize("query", ["m13_tracking_projection", "m8_shared_baseline_blend"])
def test_models_of_methods_shuffle_beats_once(spark, query):
    # besides, sums and models of sessions: three methods of each, two targets
    n, rows = rows_shuffled(spark, lambda: queries.QUERIES[query](spark, SF).collect())
    assert len(rows) == count(spark) and n <= len(rows) + 60 * len({x.session_id for x in rows})
