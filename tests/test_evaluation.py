import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_core import plain_ewma
from trackspark.operators import evaluation, projection, runtime, training
from trackspark.sources import sinks, tables
from trackspark.streaming import match

T = ("SBP", "DBP", "MAP", "PP")


def frame(n=400, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        s, d = 110 + 20 * np.sin(k / 9) + r.normal(), 70 + 8 * np.cos(k / 7) + r.normal()
        p, q = s + r.normal(scale=5), d + 3 + r.normal(scale=3)
        rows.append((k % 4, "AB"[k // 4 % 2], k, s, d, (s + 2 * d) / 3, s - d, p, q, (p + 2 * q) / 3, p - q))
    return pd.DataFrame(rows, columns=["session_id", "method", "beat_index", *[f"{x}_{t}" for x in ("ref", "pred") for t in T]])


@pytest.mark.parametrize("accuracy", [10, 100, 10000])
def test_exact_medians(spark, accuracy):
    r = np.random.default_rng(accuracy)
    p = pd.DataFrame({"g": r.integers(0, 4, 1001), "x": np.round(r.normal(size=1001) * 50), "y": r.choice([1.0, 1.0, 1.0, 2.0, np.nan], 1001)})
    p.loc[p.g == 3, "y"] = np.nan
    df = spark.createDataFrame([(int(g), float(x), None if np.isnan(y) else float(y)) for g, x, y in p.itertuples(index=False)], "g int, x double, y double").repartition(5)
    out = {o.g: (o.x, o.y) for o in evaluation.exact_medians(df, ["g"], ["x", "y"], accuracy).collect()}
    for g, own in p.groupby("g"):
        assert out[g][0] == own.x.median() and (out[g][1] == own.y.median() or (out[g][1] is None and g == 3))


def test_session_style_equals_pandas(spark):
    p = frame()
    p = p[~((p.session_id == 2) & (p.method == "B"))]
    out = evaluation.session_style(spark.createDataFrame(p).repartition(4), {"raw": {}, "low": {"pred_PP": F.col("pred_PP") - 9}}, ["beat_index"]).toPandas()
    assert len(out) == 5 * 2 * 2 * 4 and (out.n == 0).sum() == 8 and out[out.n == 0].mae.isna().all()
    for (s, m, series, t), o in out[out.n > 0].groupby(["session_id", "method", "series", "target"]):
        own = p[(p.method == m) & ((s == "ALL") | (p.session_id.astype(str) == s))].sort_values(["session_id", "beat_index"])
        ref, pred = own[f"ref_{t}"], own[f"pred_{t}"] - (9 if series == "low" and t == "PP" else 0)
        a, b = ref - ref.median(), pred - pred.median()
        o, da, db = o.iloc[0], a.diff().dropna(), b.diff().dropna()
        want = dict(
            n=len(own), mae=abs(pred - ref).mean(), rmse=((pred - ref) ** 2).mean() ** 0.5, corr=ref.corr(pred), signed_bias=(pred - ref).mean(), centered_mae=abs(b - a).mean(), tracking_gain=(a * b).sum() / (a * a).sum(),
            amplitude_ratio=b.std() / a.std(), direction_agreement=(np.sign(da) == np.sign(db)).mean(), delta_mae=abs(db - da).mean(), map_mae=abs(own.pred_MAP - own.ref_MAP).mean(), pp_signed_bias=(own.pred_PP - own.ref_PP).mean() - (9 if series == "low" else 0),
        )
        assert all(o[k] == pytest.approx(v) for k, v in want.items()), (s, m, series, t)


def test_projection_fits_each_method_alone(spark):
    p = frame(480)
    out = projection.projected(spark.createDataFrame(p), {"A": {"PP": 0.5}, "B": {}}, "session_id", ["beat_index"], least_rows=240).toPandas().sort_values("beat_index").reset_index(drop=True)
    assert len(out) == len(p)
    for m in "AB":
        own = p[p.method == m].sort_values(["session_id", "beat_index"])
        g = own.groupby("session_id")
        x, c = own.pred_PP, own.pred_MAP
        delta, high = g.pred_PP.diff().fillna(0), x - np.concatenate([plain_ewma(v.tolist(), 0.28) for _, v in g.pred_PP])
        design = np.column_stack([x - g.pred_PP.transform("median"), delta, high, delta.groupby(own.session_id).diff().fillna(0), c - g.pred_MAP.transform("median"), g.pred_MAP.diff().fillna(0)])
        y, sessions, want = (own.ref_PP - g.ref_PP.transform("median")).to_numpy(), own.session_id.to_numpy(), np.zeros(len(own))
        for s in range(4):
            train, test = design[sessions != s], design[sessions == s]
            mean, sd = train.mean(axis=0), train.std(axis=0)
            z = np.column_stack([np.ones(len(train)), (train - mean) / sd])
            coef = np.linalg.solve(z.T @ z + 3 * np.diag([0] + [1] * 6), z.T @ y[sessions != s])
            want[sessions == s] = np.column_stack([np.ones(len(test)), (test - mean) / sd]) @ coef
        part = 0.5 if m == "A" else 0.88
        pp = np.clip(g.pred_PP.transform("median") + part * want + (1 - part) * design[:, 0], 15, 100)
        got = out.set_index("beat_index").loc[own.beat_index]
        assert np.allclose(got.pred_PP, pp) and np.allclose(got.pred_SBP, got.pred_MAP + 2 * got.pred_PP / 3) and not np.allclose(got.pred_MAP, own.pred_MAP)
    few = projection.projected(spark.createDataFrame(p), {"A": {}}, "session_id", ["beat_index"], least_rows=241)
    assert few.exceptAll(spark.createDataFrame(p)).count() == 0


def test_runtime_columns(spark):
    methods = (runtime.Method("P", ("a",), ("A",)), runtime.Method("Q", ("b", "square:b"), ("B", "B2"), base="P", gap=None))
    models = {"P": {"MAP": [90, 1], "PP": [40, 2], "pp_term_scales": {"A": 0.5}}, "Q": {"MAP": [80, 1, 0.1], "PP": [50, 0, 0]}}
    rows = [(1, 1.0, 2.0, 1, " OK ", 7.0), (2, None, 2.0, 1, "ok", 7.0), (3, 1.0, 2.0, 0, "ok", 7.0), (4, 1.0, float("nan"), 1, "ok", None)]
    df = spark.createDataFrame(rows, "k int, a double, b double, Q_output_valid int, Q_reject_reason string, P_SBP double")
    out = {r.k: r for r in runtime.append_columns(df, models, methods).collect()}
    assert [out[k].P_MAP_model_raw for k in (1, 2, 3, 4)] == [91.0, None, 91.0, 91.0] and [out[k].P_SBP for k in (1, 4)] == [7.0, None]
    assert out[3].Q_SBP is None and out[4].Q_SBP is None and out[2].Q_SBP is None
    if out[1].Q_SBP is not None:
        m, p = 80 + 2 + 0.4, 50.0
        assert out[1].Q_SBP == pytest.approx(m + 2 * p / 3) and out[1].Q_SBP_term_B2 == pytest.approx(0.4) and out[1].Q_SBP_base == pytest.approx(91 + 2 * 41 / 3)
        assert out[1].Q_DBP_correction == pytest.approx(m - p / 3 - (91 - 41 / 3)) and out[1].P_PP_coef_A == 1.0
    again = runtime.append_columns(df, models, methods, preserve=False).where("k = 1").first()
    assert again.P_SBP == pytest.approx(91 + 2 * 41 / 3)
    one = runtime.prediction_rows(spark.createDataFrame([(1, 2, "b", 0.5), (1, 1, "z", 0.1), (1, 1, "a", 0.2), (2, 0, "a", 0.3)], "session_id int, row_index int, method string, x double"), "session_id", 1, ["x"]).collect()
    assert [r.x for r in one] == [0.2, 0.1, 0.5]


def test_training(spark):
    p = frame(200)
    p["f"], p["g"], p["valid"], p["reason"] = p.pred_SBP, p.pred_DBP, 1, "ok"
    p.loc[3, "f"] = np.nan
    df = spark.createDataFrame(p)
    specs = [training.Spec("one", ("f",)), training.Spec("two", ("f",), "one", ("g",)), training.Spec("none", ("f",))]
    rows = {s.name: training.samples(df.where(F.col("method") == m), s, "valid", "reason") for s, m in zip(specs, "ABC", strict=True)}
    assert rows["one"].count() == 100 - (p.method[3] == "A") and rows["one"].first().method == "one"
    models = training.train(rows, specs, 2.0)
    assert set(models) == {"one", "two"}

    def ridge(x, y):
        z = (x - x.mean()) / x.std(ddof=0)
        b = (z * y).sum() / (len(x) + 2.0)
        return y.mean() - b * x.mean() / x.std(ddof=0), b / x.std(ddof=0)

    a, b = p[(p.method == "A")].dropna(), p[(p.method == "B")].dropna()
    i, k = ridge(a.f, a.ref_PP)
    j, m = ridge(b.g, b.ref_PP - i - k * b.f)
    assert models["one"]["PP"] == pytest.approx([i, k]) and models["two"]["PP"] == pytest.approx([i + j, k, m])
    assert training.rich_features(df.withColumn("fz", F.lit(None).cast("double")), ["f", "g"]) == ["f", "g"]
    shared = training.train_baselines({n: df.where(F.col("method") == n).dropna() for n in "AB"}, ["f", "g"], "session_id", "beat_index", "ref_PP", shared="A")
    assert shared["A"] is shared["B"] and len(shared["A"].summary) == 10
    out = training.blended_series(df.where("method = 'B'"), F.lit(50.0), F.col("g"), 0.5, ["session_id"], ["beat_index"], n=5).toPandas()
    for _, own in out.sort_values("beat_index").groupby("session_id"):
        anchor = own.g.iloc[:5].median()
        assert np.allclose(own.blend, 50 + 0.5 * (own.g - anchor)) and np.allclose(own.blend_smoothed, 50 + 0.5 * (np.array(plain_ewma(own.g.tolist(), 0.3)) - anchor))


def test_sinks_of_runs(spark, tmp_path):
    sinks.write_rows(spark, [{"a": 1, "b": None}, {"a": "x,y"}], str(tmp_path / "rows"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "rows")).collect())) == [("1", None), ("x,y", None)]
    sinks.write_rows(spark, [], str(tmp_path / "none"))
    assert tables.read_back(spark, str(tmp_path / "none"), "a int").count() == 0 == tables.read_back(spark, str(tmp_path / "gone"), "a int").count()
    df = spark.createDataFrame([(1, 2.5)], "k int, x double")
    sinks.write_summary(df, str(tmp_path / "c"), str(tmp_path / "j"))
    assert tables.read_back(spark, str(tmp_path / "c"), "k int, x double").first() == df.first() == spark.read.schema("k int, x double").json(str(tmp_path / "j")).first()
    sinks.write_metadata(spark, {"widths": [5, 10], "root": tmp_path}, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value)["widths"] == [5, 10]
    events = spark.createDataFrame([(2000.5, 1.5, 3, 120.0, 80.0, 93.0, 61.0), (None, 1.0, 4, 1.0, 1.0, 1.0, 1.0), (1000.0, 0.5, 2, 119.0, 79.0, 92.0, 60.0)], "timestamp_ms double, elapsed_s double, count int, sbp double, dbp double, map double, hr double")
    back = {r["計測回数"]: r for r in sinks.fallback_beats(events).collect()}
    assert len(sinks.FALLBACK) == 17 and set(back) == {"2", "3"} and back["3"]["epoch_ns"] == "2000500000" and back["3"]["開始時刻"] == back["2"]["現在時刻"]
    assert back["2"]["Beat Sys [mmHg]"] == "119.000000000" and back["2"]["CO Raw"] == "" and back["2"]["経過時間"] == "0.500000000"


def test_refreshed_views(spark, tmp_path):
    made = []
    build = lambda df: made.append(1) or df.where("x > 1")
    view, source = str(tmp_path / "v"), str(tmp_path / "s.csv")
    with pytest.raises(FileNotFoundError):
        tables.refreshed(spark, source, view, build)
    (tmp_path / "s.csv").write_text("x\n1\n2\n3\n")
    assert tables.refreshed(spark, source, view, build, rebuild=False).count() == 2
    assert tables.refreshed(spark, source, view, build, rebuild=False).count() == 2 and len(made) == 1
    assert tables.refreshed(spark, source, view, build).count() == 2 and len(made) == 2


def test_reports(spark):
    p = spark.createDataFrame(frame())
    table = evaluation.session_style(p, {"raw": {}}, ["beat_index"], totals=False)
    text = sinks.session_report(table, 500, 400)
    assert "400 of 500" in text and text.count("## ") == 4 and "| A | raw |" in text
    summary = table.withColumns({"window_seconds": F.lit(20.0), "n_sessions": F.lit(4), **{f"mean_{m}": F.lit(0.5) for m in ("mae", "rmse", "centered_mae", "corr", "delta_corr", "detrended_corr")}})
    text = sinks.tracking_report(summary, "s1", {"primary_window_seconds": 20.0}, ["A"])
    assert "representative session: s1" in text and "| B |" not in text
    terms = spark.createDataFrame([("A", "f", 0.5), ("A", "g", 0.0)], "method string, term string, inverse_strength double")
    assert "| A | f | 0.500 |" in sinks.diagnostic_report(terms, spark.createDataFrame([("A", "f", 2)], "method string, term string, n_sessions int"))
    coef = spark.createDataFrame([("A", "PP", "f", 1.0)], "method string, target string, term string, value double")
    assert "## Models" in sinks.coefficient_report(coef, spark.createDataFrame([("ALL", "A", "refit", "PP", 0.1)], "session_id string, method string, fit string, target string, mae double"))


def test_live_streams_stop_restart_and_fail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    live = match.Live({"log": tables.followed(spark, str(tmp_path / "in"))}, str(tmp_path / "live"))
    live.queries["log"].processAllAvailable()
    assert live.health() == {"log": True} and live.stop()["log"].count() == 2
    (tmp_path / "in" / "b.txt").write_text("three")
    again = match.Live({"log": tables.followed(spark, str(tmp_path / "in"))}, str(tmp_path / "live"))
    assert again.stop()["log"].count() == 3
    bad = match.Live({"bad": tables.followed(spark, str(tmp_path / "in")).select(F.raise_error(F.lit("boom")).cast("string").alias("value"))}, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="boom"):
        bad.stop()
    with pytest.raises(RuntimeError, match="bad died"):
        bad.health()
