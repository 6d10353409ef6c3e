import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackspark.functions import scalar, statistics
from trackspark.operators import align, asof, baseline, features, frames, metrics, projection, quality, ridge, smooth, windows
from trackspark.plans import more, queries, sessions


def one(df, *columns):
    return tuple(df.select(*columns).first())


def test_scalars(spark):
    df = spark.createDataFrame([("12.5", "abc", float("nan"), float("inf"), None, "2024-01-02T03:04:05.678+09:00", "bad", "　 OK ")], "a string, b string, c double, d double, e double, f string, g string, h string")
    assert one(df, scalar.number("a"), scalar.number(F.col("b")), scalar.number(F.col("c")), scalar.number(F.col("d")), scalar.integer(F.col("a"))) == (12.5, None, None, None, 12)
    assert one(df, scalar.tidy(F.col("h")), scalar.tidy(F.col("e")), scalar.epoch_ms_from_iso(F.col("f")), scalar.epoch_ms_from_iso(F.col("g"))) == ("ok", "", 1704132245678, None)
    assert one(df, scalar.iso_from_epoch_ms(F.lit(1704132245678)), scalar.fixed(F.lit(1.5), 3, True), scalar.fixed(F.col("e"), 2), scalar.epoch_ms_from_ns(F.lit(1_500_000))) == ("2024-01-01T18:04:05.678Z", "+1.500", "", 1.5)
    assert one(df, scalar.safe_divide(F.lit(1.0), F.lit(0.0)), scalar.clamp(F.col("e"), 0.0, 1.0), scalar.clamp(F.lit(5.0), 0.0, 1.0)) == (None, None, 1.0)
    s, d = scalar.plausible(F.lit(100.0), F.lit(95.0))
    assert one(df, s, d) == (115.0, 95.0)
    v, swapped = scalar.anchored(F.lit(300.0), F.lit(120.0), 60.0, 200.0)
    assert one(df, v, swapped, scalar.finite(F.col("c")), scalar.finite(F.lit(1.0))) == (120.0, True, False, True)
    arrays = F.array(F.lit(90.0), F.lit(3.0)), F.array(F.lit(30.0), F.lit(0.0))
    assert one(df, scalar.systolic_terms(*arrays), scalar.diastolic_terms(*arrays)) == ([110.0, 3.0], [80.0, 3.0])


@given(st.floats(60, 200), st.floats(40, 150))
@settings(max_examples=10, deadline=None)
def test_pressure_identities(spark, s, d):
    m, p = scalar.mean_pressure(F.lit(s), F.lit(d)), scalar.pulse_pressure(F.lit(s), F.lit(d))
    assert one(spark.range(1), scalar.systolic(m, p), scalar.diastolic(m, p)) == pytest.approx((s, d))


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 5.0, 5.0), (None, 9.0, 5.0)], "a double, b double, c double")
    a, b = np.array([1.0, 2, 3]), np.array([2.0, 4.5, 5])
    got = df.agg(statistics.pearson(F.col("a"), F.col("b")), statistics.pearson(F.col("a"), F.col("c")), statistics.pearson(F.col("a"), F.col("b"), 4), statistics.tracking_gain(F.col("a"), F.col("b")), statistics.mae(F.col("a")), statistics.same_sign(F.col("a") - 2, F.col("b") - 4.4)).first()
    assert got[0] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got[1] is None and got[2] is None
    assert got[3] == pytest.approx((a @ b) / (a @ a)) and got[4] == 2.0 and got[5] == 1.0


def test_frames(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 1.0)], "k long, ` x ` double, y double")
    df = frames.stripped(df)
    assert frames.prefixed(df, "m_", ["k"]).columns == ["k", "m_x", "m_y"]
    assert frames.with_prefix(df, ["y"], ["k"]).columns == ["k", "y"] and frames.available(df, ["y", "no", "k"]).columns == ["y", "k"]
    assert frames.backed_up(df, ["x", "no"]).columns == ["k", "x", "y", "x_export"]
    assert frames.with_finite_values(df.withColumn("z", F.lit("bad")), ["x", "y", "z"]) == ["x", "y"]
    over = spark.createDataFrame([(0, None, "a"), (5, 9.0, "b")], "row_index int, x double, new string")
    got = frames.overlaid(frames.numbered(df, [], ["k"]), over, []).orderBy("k").collect()
    assert [(r.k, r.x, r.new) for r in got] == [(1, None, "a"), (2, 3.0, None)]
    assert frames.replaced(df, {"x": F.lit(0.0), "w": F.lit(1.0)}, preserve=True).where("x = 2").count() == 1
    both = frames.priority_union(df.select("k"), spark.createDataFrame([(2,), (3,)], "k long"), "k").collect()
    assert sorted((r.k, r.origin) for r in both) == [(1, "current"), (2, "current"), (3, "past")]


def test_predicates(spark):
    rows = [(1, "ok", 0, 100.0), (1, " ok", None, -350.0), (0, "ok", 1, None), (None, None, 0, 351.0), (1, "OK", 0, 1.0)]
    df = spark.createDataFrame(rows, "v int, r string, a int, d double").withColumns({"g": F.lit(1), "i": F.monotonically_increasing_id()})
    out = df.withColumn("near", quality.near_in_time(F.col("d"), ["g"])).select("i", quality.valid_strict(F.col("v"), F.col("r")), quality.valid_lenient(F.col("r")), quality.valid_lenient(F.col("r"), False), quality.no_artifact(F.col("a")), "near").orderBy("i").collect()
    assert [tuple(x)[1:] for x in out] == [(True, True, True, True, True), (True, True, True, True, True), (False, True, True, False, False), (False, True, True, True, False), (False, True, False, True, True)]
    assert df.withColumn("d", F.lit(None).cast("double")).withColumn("n", quality.near_in_time(F.col("d"), ["g"])).where("n").count() == 5


def test_mad_gate(spark):
    r = random.Random(3)
    rows = [(s, r.gauss(50, 8) if r.random() < 0.9 else None) for s in (1, 2) for _ in range(50)] + [(1, 99.0), (3, None)]
    df = spark.createDataFrame(rows, "s long, v double")
    got = {x.s: x for x in quality.mad_bounds(df, F.col("v"), ["s"], low=15.0, high=100.0).collect()}
    for s in (1, 2):
        v = np.array([x for k, x in rows if k == s and x is not None])
        c = np.median(v)
        band = max(8, 3 * 1.4826 * np.median(abs(v - c)))
        assert (got[s].lower, got[s].upper) == pytest.approx((max(c - band, 15), min(c + band, 100)))
    gated = quality.mad_gated(df, F.col("v"), ["s"], low=15.0, high=100.0)
    assert gated.where("s = 3 and passes and inlier = 0").count() == 1 and gated.where("v = 99 and passes").count() == 0
    assert quality.supported(df, ["s"], 2).select("s").distinct().count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_nearest_join_equals_pandas(spark, seed):
    r = random.Random(seed)
    left = pd.DataFrame({"k": [r.randint(0, 3) for _ in range(120)], "t": [float(r.randint(0, 200)) for _ in range(120)], "seq": range(120)})
    right = pd.DataFrame({"k": [r.randint(0, 3) for _ in range(90)], "t": [float(r.randint(0, 200)) for _ in range(90)], "seq": range(90)})
    right["v"] = right["seq"] * 10
    want = pd.merge_asof(left.sort_values(["t", "seq"]), right.sort_values(["t", "seq"]).drop(columns="seq").assign(rt=lambda d: d.t), on="t", by="k", direction="nearest", tolerance=5.0)
    out = asof.nearest(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", 5.0, "seq").repartition(3).toPandas()
    both = want[["seq", "v", "rt"]].merge(out[["seq", "v", "ref_time"]], on="seq", suffixes=("", "_got"))
    assert len(both) == 120
    assert np.array_equal(both.v.to_numpy(float), both.v_got.to_numpy(float), equal_nan=True) and np.array_equal(both.rt.to_numpy(float), both.ref_time.to_numpy(float), equal_nan=True)


def plain_ewma(xs, alpha):
    out, state = [], None
    for x in xs:
        if x is not None:
            state = x if state is None else alpha * x + (1 - alpha) * state
        out.append(None if x is None else state)
    return out


@pytest.mark.parametrize("alpha", [0.28, 0.5, 1.0])
def test_smoothing(spark, alpha):
    r = random.Random(1)
    rows = [(s, i, r.gauss(90, 10) if r.random() < 0.7 else None) for s in (1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "s long, i long, x double").repartition(5)
    out = smooth.smoothed(df, {"e": F.col("x")}, alpha, ["s"], ["i"]).orderBy("s", "i").collect()
    for s in (1, 2):
        own = [o for o in out if o.s == s]
        want = plain_ewma([o.x for o in own], alpha)
        assert all((w is None) == (o.e is None) and (w is None or abs(w - o.e) < 1e-9) for w, o in zip(want, own, strict=True))
        assert min(o.x for o in own if o.x) <= min(o.e for o in own if o.e)


def test_features_and_windows(spark):
    rows = [(1, i, float(x)) for i, x in enumerate([3, 1, 4, 1, 5, 9, 2, 6])]
    df = spark.createDataFrame(rows, "s long, i long, x double")
    k, o, x = ["s"], ["i"], F.col("x")
    got = df.select("i", features.centered(x, k).alias("c"), features.difference(x, k, o).alias("d"), features.shifted(x, 2, k, o).alias("b"), features.shifted(x, -2, k, o).alias("f"), features.prefix_median(x, 3, k, o).alias("p"), features.transformed(x, 1, -1.0, 2.0, k, o).alias("t")).orderBy("i").collect()
    v = np.array([r[2] for r in rows])
    assert [g.c for g in got] == (v - np.median(v)).tolist() and [g.d for g in got][1:] == np.diff(v).tolist() and got[0].d is None
    assert [g.b for g in got] == [3, 1, *v[:-2]] and [g.f for g in got] == [*v[2:], 2, 6] and {g.p for g in got} == {3.0}
    assert [g.t for g in got] == (np.median(v) - 2 * (np.array([3, *v[:-1]]) - np.median(v))).tolist()
    w = windows.tumbling(df.withColumn("n", F.lit(None).cast("double")), ["s"], "i", [3, 4], ["x", "n"]).collect()
    assert sorted((r.window_seconds, r.window_index, r.beat_count) for r in w) == [(3.0, 0, 3), (3.0, 1, 3), (3.0, 2, 2), (4.0, 0, 4), (4.0, 1, 4)]
    assert features.first_rows(df, k, o, 3).count() == 3


def beats(spark, n=3, size=60, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        for i in range(size):
            x = r.normal(size=2)
            m, p = 90 + 3 * x[0] + s, 45 + 4 * x[1]
            rows.append((s, "A" if i % 2 else "B", i, i, float(x[0]), float(x[1]), float(m), float(p), float(m + r.normal()), float(p + r.normal())))
    df = spark.createDataFrame(rows, "session_id long, method string, beat_index long, elapsed_s long, f double, g double, ref_MAP double, ref_PP double, pred_MAP double, pred_PP double")
    for s in ("ref", "pred"):
        m, p = F.col(f"{s}_MAP"), F.col(f"{s}_PP")
        df = df.withColumns({f"{s}_SBP": scalar.systolic(m, p), f"{s}_DBP": scalar.diastolic(m, p)})
    return df


def plain_ridge(x, y, alpha):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    pen = alpha * np.eye(z.shape[1])
    pen[0, 0] = 0
    b = np.linalg.solve(z.T @ z + pen, z.T @ y)
    return np.concatenate([[b[0] - (b[1:] * mean / scale).sum()], b[1:] / scale])


def test_ridge_and_folds(spark):
    df = beats(spark).withColumn("one", F.lit(7.0))
    p = df.orderBy("session_id", "beat_index").toPandas()
    names = ["f", "g", "one"]
    assert ridge.fit(df, names, "ref_PP", 2.0) == pytest.approx(plain_ridge(p[names].to_numpy(), p.ref_PP.to_numpy(), 2.0))
    folds = ridge.fit_folds(df, names, "ref_PP", "session_id", 2.0)
    for s, coef in folds.items():
        rest = p[p.session_id != s]
        assert coef == pytest.approx(plain_ridge(rest[names].to_numpy(), rest.ref_PP.to_numpy(), 2.0))
    got = ridge.replay(df, folds, names, "session_id", "hat").orderBy("session_id", "beat_index").toPandas()
    assert got.hat[5] == pytest.approx(folds[0][0] + folds[0][1:] @ p.loc[5, names].to_numpy(float))
    assert ridge.fit_folds(df, names, "ref_PP", "session_id", least_rows=1000) == {}
    with pytest.raises(ValueError):
        ridge.solve(np.zeros((3, 3)), 1.0)


def test_scales_and_stages(spark):
    df = beats(spark)
    p = df.toPandas()
    c, cols = {"intercept": 40.0, "f": 1.0, "g": 2.0}, {"f": "f", "g": "g"}
    got = ridge.fit_scales(df, c, cols, ["g"], "ref_PP", alpha=25.0)
    t, y = 2.0 * p.g.to_numpy(), p.ref_PP.to_numpy() - 40 - p.f.to_numpy()
    assert got["g"] == pytest.approx(np.clip(1 + (t @ (y - t)) / (t @ t + 25), -3, 3))
    both = ridge.fit_two_stage(df, df, ["f"], ["g"], "ref_PP", 1.0)
    a = plain_ridge(p[["f"]].to_numpy(), p.ref_PP.to_numpy(), 1.0)
    b = plain_ridge(p[["g"]].to_numpy(), p.ref_PP.to_numpy() - a[0] - a[1] * p.f.to_numpy(), 1.0)
    assert both == pytest.approx([a[0] + b[0], a[1], b[1]])
    parts = one(df, *ridge.terms([1.0, 2.0], ["f"]).values())
    assert parts[0] == 1.0 and parts[1] == pytest.approx(2 * df.first().f)


def test_baselines(spark):
    df = beats(spark, n=5)
    p = df.toPandas()
    s = {r.session_id: r for r in baseline.initial_summary(df.withColumn("none", F.lit(None).cast("double")), ["g", "none"], ["ref_PP"], "session_id", "beat_index", 30).collect()}
    own = p[(p.session_id == 1) & (p.beat_index < 30)].sort_values("beat_index")
    assert (s[1].g_median, s[1].g_std, s[1].g_p10, s[1].g_p90, s[1].g_delta) == pytest.approx((own.g.median(), own.g.std(ddof=0), np.percentile(own.g, 10), np.percentile(own.g, 90), own.g.iloc[-1] - own.g.iloc[0]))
    assert s[1].none_median == 0 and s[1].ref_PP_anchor == pytest.approx(own.ref_PP.median())
    model = baseline.train(df, ["f", "g"], "ref_PP", "session_id", "beat_index")
    out = baseline.replay(df, model, "session_id", "beat_index", "pp", low=15.0, high=100.0)
    assert out.agg(F.avg(F.abs(F.col("pp") - F.col("ref_PP")))).first()[0] < 2
    with pytest.raises(ValueError):
        baseline.train(df.where("session_id = 0"), ["f"], "ref_PP", "session_id", "beat_index")


def test_projection_and_candidates(spark):
    df = beats(spark)
    many = df.withColumns({f"pred_{t}": F.col(f"pred_{t}") for t in ("MAP", "PP")})
    out = projection.projected(many, {"A": {}, "B": {}, "C": {}}, "session_id", ["beat_index"], least_rows=1, least_sessions=1, least_fold=10_000)
    assert out.columns == df.columns and out.where("pred_PP is null").count() == 0
    kept = out.join(df.select("session_id", "method", "beat_index", F.col("pred_MAP").alias("before")), ["session_id", "method", "beat_index"])
    assert kept.where("abs(pred_MAP - before) > 1e-9").count() == 0
    out, models = projection.candidates(df.withColumn("flat", F.lit(45.0)), [], ["f", "g"], "ref_PP", "flat", "session_id", ["beat_index"], n=1, smoothing=1.0)
    assert projection.fold_correlation(out, "candidate_a", "ref_PP", "session_id").where("corr < 0.95").count() == 0
    assert {tuple(r) for r in models.where("candidate = 'b'").select("feature").distinct().collect()} == {("intercept",), ("g",)}
    top = projection.leading_features(df, ["f", "g"], "ref_PP", "session_id", 1).collect()
    p = df.toPandas()
    for r in top:
        rest = p[p.session_id != r.held_out]
        assert r.feature == "g" and r.strength == pytest.approx(abs(np.corrcoef(rest.g, rest.ref_PP)[0, 1]))


def test_alignment_recovers_a_shift(spark):
    r = np.random.default_rng(0)
    m = 90 + np.cumsum(r.normal(size=40))
    rows = [(0, "A", i, float(m[i]), float(40 + m[i] / 10), float(-m[min(i + 2, 39)] + 180), float(40 + m[i] / 10)) for i in range(40)] + [(1, "A", 0, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "session_id long, method string, i long, ref_MAP double, ref_PP double, pred_MAP double, pred_PP double")
    for s in ("ref", "pred"):
        df = df.withColumns({f"{s}_SBP": F.col(f"{s}_MAP") + 2 * F.col(f"{s}_PP") / 3, f"{s}_DBP": F.col(f"{s}_MAP") - F.col(f"{s}_PP") / 3})
    out = align.aligned(df, ["session_id", "method"], "i", "method").orderBy("session_id", "i").collect()
    assert {(x.map_lag, x.map_sign, x.pp_lag) for x in out if x.session_id == 0} == {(2, -1.0, 0)} and len(out) == 41
    assert out[-1].pred_MAP == 3.0


def steps_correlate(x, ref, n):
    return pd.Series(x[:n]).diff().corr(pd.Series(ref[:n]).diff()) if (pd.Series(x[:n]).diff().notna() & pd.Series(ref[:n]).diff().notna()).sum() >= 3 else np.nan


def plainly_aligned(g, s):
    """Every candidate by itself, as series."""
    x = {t: g[f"pred_{t}"].reset_index(drop=True) for t in ("MAP", "PP")}
    ref = {t: g[f"ref_{t}"].reset_index(drop=True) for t in ("MAP", "PP", "SBP", "DBP")}

    def variant(t, lag, sign, gain):
        late = x[t].shift(lag)
        late = late.where(late.notna(), x[t])
        middle = x[t].median() if x[t].notna().any() else 0.0
        return middle + sign * gain * (late - middle)

    def search(score):
        best = [None, -np.inf]
        spans = [n if n >= 4 else 0 for n in (min(s.calibration, len(g)), len(g))]
        each = [[(round(score(c, n), 9), c) for c in [(lag, sign, gain) for lag in s.lags for sign in s.signs for gain in s.gains]] for n in spans]
        tops = [max((v for v, _ in e if v == v), default=-np.inf) for e in each]
        k = 1 if tops[0] < s.reliable and tops[1] > tops[0] else 0
        return next((c for v, c in each[k] if v == tops[k]), (0, 1.0, 1.0)) if best else None

    one = search(lambda c, n: np.sign(c[1]) * steps_correlate(variant("MAP", c[0], 1.0, 1.0), ref["MAP"], n))
    m = variant("MAP", *one)

    def pulse(c, n):
        p = variant("PP", *c)
        each = [steps_correlate(y, ref[t], n) for y, t in ((p, "PP"), (m + 2 * p / 3, "SBP"), (m - p / 3, "DBP"))]
        known = [(w, v) for w, v in zip(s.weights, each, strict=True) if v == v]
        return sum(w * v for w, v in known) / sum(w for w, _ in known) if known else np.nan

    two = search(pulse)
    p = variant("PP", *two)
    return one, two, (1 - s.blend) * x["MAP"] + s.blend * m.where(m.notna(), x["MAP"]), (1 - s.blend) * x["PP"] + s.blend * p.where(p.notna(), x["PP"])


def test_alignment_tries_every_candidate(spark):
    r = np.random.default_rng(3)
    frames = []
    for k, n in enumerate((3, 5, 9, 30, 30, 41)):
        walk = {c: 60 + np.cumsum(r.normal(size=n)) for c in ("ref_MAP", "ref_PP", "pred_MAP", "pred_PP")}
        g = pd.DataFrame({"session_id": k, "method": "AB"[k % 2], "i": range(n), **walk})
        for side in ("ref", "pred"):
            g[f"{side}_SBP"], g[f"{side}_DBP"] = g[f"{side}_MAP"] + 2 * g[f"{side}_PP"] / 3, g[f"{side}_MAP"] - g[f"{side}_PP"] / 3
        if n > 10:
            g.loc[r.integers(0, n, 4), "pred_MAP"] = None
            g.loc[r.integers(0, n, 3), ["ref_PP", "ref_SBP"]] = None
        frames.append(g)
    p = pd.concat(frames)
    search = {"A": align.Search(signs=(1.0,), blend=0.8), "B": align.Search(lags=(-2, 0, 1), calibration=6, reliable=0.9)}
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "session_id long, method string, i long, " + ", ".join(f"{c} double" for c in p.columns[3:])).repartition(3)
    out = align.aligned(df, ["session_id", "method"], "i", "method", search).toPandas().sort_values(["session_id", "i"])
    for k, g in p.groupby("session_id"):
        got = out[out.session_id == k]
        if len(g) < 4:
            assert got.pred_PP.tolist() == g.pred_PP.tolist() and set(got.map_lag) == {0}
            continue
        one, two, m, q = plainly_aligned(g, search[g.method.iloc[0]])
        assert (got.map_lag.iloc[0], got.map_sign.iloc[0], got.map_gain.iloc[0]) == one and (got.pp_lag.iloc[0], got.pp_sign.iloc[0], got.pp_gain.iloc[0]) == two
        assert np.allclose(got.pred_MAP.astype(float), m.astype(float), equal_nan=True) and np.allclose(got.pred_PP.astype(float), q.astype(float), equal_nan=True)


def test_beats_are_aligned_with_made_up_places(spark):
    df = beats(spark).where("session_id = 1 and method = 'A'").drop("method")
    bare = df.drop("session_id", "elapsed_s").withColumnRenamed("beat_index", "at")
    out = align.aligned_beats(bare, "A", "at")
    assert out.columns == bare.columns and out.count() == df.count()
    whole = align.aligned_beats(df, "A", "beat_index")
    assert sorted(round(r.pred_PP, 9) for r in out.collect()) == sorted(round(r.pred_PP, 9) for r in whole.collect())
    assert align.aligned_beats(df.drop("ref_SBP"), "A", "beat_index").columns == df.drop("ref_SBP").columns


def test_totals_agree_with_sessions(spark):
    df = metrics.paired(beats(spark), ["session_id", "method", "beat_index"], sessions.TARGETS)
    out = metrics.errors_by_session_and_all(df, ["method", "target"]).toPandas()
    for (m, t), g in out.groupby(["method", "target"]):
        whole, each = g[g.session_id == "ALL"].iloc[0], g[g.session_id != "ALL"]
        assert whole.n == each.n.sum() and whole.mae == pytest.approx((each.mae * each.n).sum() / whole.n)


def test_measures_are_invariant(spark):
    df = metrics.paired(beats(spark), ["session_id", "beat_index"], {"PP": ("ref_PP", "pred_PP")})
    keys = ["session_id", "target"]

    def measured(x):
        return metrics.metrics(metrics.centered_samples(x, keys, ["beat_index"]), keys).orderBy("session_id").toPandas()

    a, b = measured(df), measured(df.withColumn("pred", 3 * F.col("pred") + 10).repartition(7))
    assert b["corr"].tolist() == pytest.approx(a["corr"].tolist()) and b.tracking_gain.tolist() == pytest.approx((3 * a.tracking_gain).tolist())
    assert b.direction_agreement.tolist() == pytest.approx(a.direction_agreement.tolist())


def test_entry_points(spark):
    df = beats(spark).withColumns({"valid": F.col("beat_index") % 5 != 0, "artifact_flag": F.lit(0), "abs_time_delta_ms": F.lit(10.0)})
    found = sessions.evaluate(df)
    assert found["metrics"].where("series = 'smoothed' and target = 'MAP'").count() == 6
    tracked = sessions.track(df, (5, 10), lag_search=True, project={"A": {}, "C": {"MAP": 0.2}})
    assert tracked["summary"].count() == 16 and tracked["representative"].count() == 1
    found = sessions.search(df, {"A": ["f", "g"], "C": ["f"]})
    held = found["summary"].where("session_id = 'ALL' and fit = 'held_out' and target = 'PP'").first()
    assert held.n == 90 and found["coefficients"].count() == 6
    ref = df.select("session_id", F.col("elapsed_s").cast("double").alias("timestamp_ms"), "beat_index", F.col("ref_PP").alias("ref"))
    assert sessions.merge(df.select("session_id", (F.col("elapsed_s") + 0.2).alias("timestamp_ms"), "beat_index"), ref).where("ref is null").count() == 0


def test_queries_and_their_sql_go_by_the_same_names():
    assert more and set(queries.ORACLES) <= set(queries.QUERIES) and queries.FLAGSHIP in queries.QUERIES
