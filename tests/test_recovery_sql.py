import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_core import plain_ewma
from tests.test_folds import frame, ridge, summary
from trackspark import sqlfunctions
from trackspark.operators import baseline, runtime, training
from trackspark.plans import sessions
from trackspark.sources import recover, sinks
from trackspark.streaming import match, watch

EVENTS = "timestamp_ms double, elapsed_s double, count long, sbp double, dbp double, map double, hr double"


def test_smoothing_as_a_table_function(spark):
    sqlfunctions.register(spark)
    xs = [1.0, None, 3.0, float("nan"), 2.0, 7.0]
    spark.createDataFrame([(k, i, x) for k in (1, 2) for i, x in enumerate(xs[: 6 - k])], "k long, i long, x double").repartition(3).createOrReplaceTempView("t_ewma")
    got = spark.sql("SELECT * FROM ewma(TABLE(SELECT k, i, x FROM t_ewma) PARTITION BY k ORDER BY (i), 'x', 0.5D)").collect()
    for k in (1, 2):
        want = plain_ewma([None if x is None or x != x else x for x in xs[: 6 - k]], 0.5)
        assert [r.smoothed for r in sorted(got, key=lambda r: r.i) if r.k == k] == want
    for bad in ("'y', 0.5D", "'x', 0D", "'x', 2D"):
        with pytest.raises(Exception, match="ewma"):
            spark.sql(f"SELECT * FROM ewma(TABLE(t_ewma) PARTITION BY k ORDER BY (i), {bad})").collect()
    row = spark.sql("SELECT bp_map(120, 60) AS m, bp_pp(120, 60) AS p, bp_sbp(80, 60) AS s, bp_dbp(80, 60) AS d, bp_clamp(5, 10, 20) AS c, bp_clamp(NULL, 10, 20) AS n").first()
    assert tuple(row) == (80.0, 60.0, 120.0, 60.0, 10.0, None)


def test_a_session_is_recovered_from_what_is_left(spark, tmp_path):
    phone, archive, local = (str(tmp_path / n) for n in ("phone/s1.csv", "archive/s1", "local.csv"))
    (tmp_path / "phone").mkdir()
    (tmp_path / "phone" / "other.csv").write_text("x\n1\n")
    with pytest.raises(FileNotFoundError, match=r"there are: other\.csv"):
        recover.recovered(spark, phone, archive)
    with pytest.raises(FileNotFoundError, match="no files"):
        recover.recovered(spark, str(tmp_path / "gone" / "x.csv"), archive)
    (tmp_path / "phone" / "s1.csv").write_text("timestamp,x\n1000,1\n")
    nothing = spark.createDataFrame([(None, 1.0, 1, 2.0, 3.0, 4.0, 5.0)], EVENTS)
    for events in (None, nothing):
        with pytest.raises(FileNotFoundError, match="no beats"):
            recover.recovered(spark, phone, archive, local, events)
    events = spark.createDataFrame([(1000.0, 1.0, 1, 120.0, 80.0, 93.0, 60.0)], EVENTS)
    beats, ref = recover.recovered(spark, phone, archive, local, events)
    assert beats.count() == 1 and ref.first()["timestamp_ms"] == 1000.0 and set(sinks.FALLBACK) <= set(ref.columns)
    (tmp_path / "local.csv").write_text("epoch_ns,beat_sys\n5000000,1\n6000000,2\n")
    assert recover.archived_beats(spark, archive, local).count() == 1  # what is archived goes first
    assert recover.archived_beats(spark, str(tmp_path / "again"), local).count() == 2 and recover.archived_beats(spark, str(tmp_path / "again")).count() == 2
    for s, names in (("a", ["a_merged.csv", "x.csv"]), ("b", ["x.csv"])):
        (tmp_path / "root" / s).mkdir(parents=True)
        for n in names:
            (tmp_path / "root" / s / n).write_text("")
    assert recover.artifacts_present(spark, str(tmp_path / "root"), ["a", "b", "c"], ["{session}_merged.csv", "x.csv"]) == ["a"]


def test_a_stream_that_dies_tells_its_last_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\nno number\n")
    lines = spark.readStream.text(str(tmp_path / "in"))
    seen = watch.watched(spark, lines=5)
    try:
        live = match.Live({"bad": lines.select(F.raise_error(F.col("value")).cast("string").alias("n"))}, str(tmp_path / "out"), watch=seen)
        with pytest.raises(Exception):  # noqa: B017  the stream's own error
            live.queries["bad"].awaitTermination(60)
        run = str(live.queries["bad"].runId)
        for _ in range(100):
            if run in seen.errors:
                break
            live.queries["bad"].awaitTermination(0.1) if live.queries["bad"].isActive else __import__("time").sleep(0.1)
        with pytest.raises(RuntimeError, match="before its first row"):
            live.health()
        assert run in seen.errors and "died" in seen.tail(run)
        good = match.Live({"good": lines}, str(tmp_path / "out2"), watch=seen)
        assert good.stop()["good"].count() == 2
    finally:
        spark.streams.removeListener(seen)


def test_two_level_models_of_all_sessions(spark):
    p = frame(4)
    out = baseline.held_out(spark.createDataFrame(p), ["f"], {"PP": "ref_PP"}, "s", "k", "method", ("median",), leave_out=False).toPandas()
    own = p[p.method == "A"]
    sums = {s: summary(own[own.s == s], ["f"], ("median",)) for s in range(4)}
    anchors = {s: v[1].ref_PP.median() for s, v in sums.items()}
    level, _ = ridge(np.stack([sums[s][0] for s in range(4)]), np.array(list(anchors.values())), 10.0)
    x, y = np.concatenate([own[own.s == s][["f"]] - sums[s][1].f.median() for s in range(4)]), np.concatenate([own[own.s == s].ref_PP - anchors[s] for s in range(4)])
    change, _ = ridge(x, y, 1.0)
    got = out[(out.method == "A") & (out.s == 2)].sort_values("k")
    test = own[own.s == 2].sort_values("k")
    assert np.allclose(got.PP_heldout, level[0] + level[1] * sums[2][0][0] + change[0] + change[1] * (test.f - sums[2][1].f.median()))


def test_only_the_sessions_named_are_made_anew(spark, tmp_path):
    p = frame(3, 35).rename(columns={"s": "session_id", "k": "beat_index"})
    for t in ("SBP", "DBP"):
        p[f"ref_{t}"] = p.ref_MAP + (2 if t == "SBP" else -1) * p.ref_PP / 3
    pairs = sessions.experimental(spark.createDataFrame(p), ["f"], ["f", "g"], "A")
    names = ["initial_baseline", "rich_baseline", "rich_dynamic_blend", "shared_baseline"]
    found = sessions.experimental_summary(pairs).select("session_id", "method", "series", "kind", "target", "n", "mae")
    pd_ = found.toPandas()
    assert sorted(pd_.series.unique()) == names and len(pd_) == 3 * 2 * 4 * 2 * 4 and set(pd_.n) == {35}
    table = spark.createDataFrame(pd_)
    path = str(tmp_path / "summary")
    sessions.rebuilt(table.withColumn("mae", F.lit(-1.0)), path)
    out = sessions.rebuilt(table, path, [1]).toPandas()
    assert len(out) == len(pd_) and set(out[out.session_id != 1].mae) == {-1.0} and (out[out.session_id == 1].mae >= 0).all()
    assert isinstance(out, pd.DataFrame)


def test_experimental_methods_as_columns(spark):
    row = {"SinBP_D_E2_A_used": 2.0, "M2_HR_used": 60.0, "M2_V2P_relTTP_used": 0.3, "M2_P2V_relTTP_used": 0.7, "SinBP_D_E2_E_used": 3.0, "SinBP_D_EOnly_A_used": None, "SinBP_D_EOnly_E_used": 1.0}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    e2, only = [50.0, 1.0, 0.1, 2.0, 3.0, 4.0, 0.5], [50.0, 1.0, 0.1, 2.0, 3.0, 4.0]
    out = runtime.append_columns(df, {"SinBP_D_E2": {"MAP": e2, "PP": e2}, "SinBP_D_EOnly": {"MAP": only, "PP": only}}).first()
    plain = 50 + 2 + 6 + 0.6 + 2.1
    assert out["SinBP_D_E2_MAP_model_raw"] == pytest.approx(plain + 12 + 4.5) and out["SinBP_D_E2_PP_model_raw"] == pytest.approx(plain + 0.65 * 16.5)
    assert out["SinBP_D_EOnly_MAP_model_raw"] is None and out["SinBP_D_E2_PP_coef_E2"] == pytest.approx(0.325)


def test_blends_have_the_gain_of_their_method(spark):
    r = np.random.default_rng(4)
    p = pd.DataFrame([(m, 1, k, *r.normal(size=4)) for m in "AB" for k in range(40)], columns=["method", "s", "k", "rm", "rp", "dm", "dp"])
    p.loc[5, "dm"] = None
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "method string, s long, k long, rm double, rp double, dm double, dp double")
    rich, dynamic = {"MAP": F.col("rm"), "PP": F.col("rp")}, {"MAP": F.col("dm"), "PP": F.col("dp")}
    out = training.tracking_blend(df, rich, dynamic, {"MAP": {None: 0.3, "B": 0.8}, "PP": {"A": 0.5}}, "s", ["k"]).toPandas()
    assert out.columns[:7].tolist() == p.columns.tolist() and not any(c.startswith("__") for c in out.columns)
    for m, gm, gp in (("A", 0.3, 0.5), ("B", 0.8, 0.25)):
        own = p[(p.method == m)].dropna().sort_values("k")
        got = out[(out.method == m) & out.dm.notna()].sort_values("k")
        for t, x, d, g, alpha in (("MAP", "rm", "dm", gm, 0.3), ("PP", "rp", "dp", gp, 0.5)):
            sx, sd = (np.array(plain_ewma(own[c].tolist(), alpha)) for c in (x, d))
            assert np.allclose(got[f"blend_{t}_raw"], own[x] + g * (own[d] - own[d].head(30).median()))
            assert np.allclose(got[f"blend_{t}"], sx + g * (sd - np.median(sd[:30])))
        assert np.allclose(got.blend_SBP - got.blend_DBP, got.blend_PP)
    assert out[out.dm.isna()].blend_MAP.isna().all()
