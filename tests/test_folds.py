import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackspark.operators import baseline, folds, projection


def ridge(x, y, alpha):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd == 0, 1.0, sd)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    b = np.linalg.solve(z.T @ z + alpha * np.diag([0] + [1] * x.shape[1]), z.T @ y)
    return np.concatenate([[b[0] - (b[1:] / sd) @ mean], b[1:] / sd]), b


def frame(sessions=5, n=45, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(sessions):
        for m in "AB":
            level = 50 + 8 * r.normal()
            for k in range(n):
                f, g, h = level / 10 + r.normal(), r.normal(), 1e6 + r.normal()
                rows.append((s, m, k, f, g, h, 90 + 3 * f + g + r.normal(), level + 2 * g + f + r.normal(), level + r.normal()))
    return pd.DataFrame(rows, columns=["s", "method", "k", "f", "g", "h", "ref_MAP", "ref_PP", "pred_PP"])


def test_models_without_each_session(spark):
    p = frame()
    p.loc[[3, 50, 51], "g"] = np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "s long, method string, k long, f double, g double, h double, ref_MAP double, ref_PP double, pred_PP double").repartition(3)
    names = ["f", "g", "h"]
    found = folds.leave_one_out(folds.moments(df, [F.col(c) for c in names], F.col("ref_PP"), ["method", "s"]), "s", 2.0, ["method"])
    models = {(r.method, r.s): r for r in found.models.collect()}
    assert len(models) == 10
    for (m, s), r in models.items():
        rest = p[(p.method == m) & (p.s != s)].dropna()
        want, _ = ridge(rest[names].to_numpy(), rest.ref_PP.to_numpy(), 2.0)
        assert np.allclose(np.array(r.coef)[1:], want[1:], rtol=1e-6) and (r.n, r.sessions) == (len(rest), 4)
        assert r.rows == len(p[(p.method == m) & (p.s != s)])
    out = folds.replay(df, found.models, [F.col(c) for c in names], ["method", "s"], "hat").toPandas()
    want = [np.dot(models[m, s].coef, [1.0, *x]) for m, s, x in zip(out.method, out.s, out[names].to_numpy(), strict=True)]
    assert out.hat.isna().sum() == 3 and np.allclose(out.hat, want, equal_nan=True)
    whole = found.whole[("A",)]
    assert np.allclose(whole.solve(2.0)[1:], ridge(p[p.method == "A"].dropna()[names].to_numpy(), p[p.method == "A"].dropna().ref_PP.to_numpy(), 2.0)[0][1:], rtol=1e-6)


def test_sessions_alone_or_null_and_empty_tables(spark):
    kind = "s long, f double, y double"
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 3.0), (1, 1.0, 1.0), (1, 3.0, 2.0), (2, None, 1.0)], kind)
    each = folds.moments(df, [F.col("f")], F.col("y"), ["s"])
    models = {r.s: r for r in folds.leave_one_out(each, "s", 1.0).models.collect()}
    assert set(models) == {None, 1, 2} and models[2].sessions == 2 and models[None].n == 2
    assert folds.replay(df, folds.leave_one_out(each, "s", 1.0).models, [F.col("f")], ["s"], "hat").where("s is null and hat is null").count() == 0
    one = folds.leave_one_out(folds.moments(df.where("s = 1"), [F.col("f")], F.col("y"), ["s"]), "s", 1.0)
    assert one.models.count() == 0
    none = folds.leave_one_out(folds.moments(df.where("s = 9"), [F.col("f")], F.col("y"), ["s"]), "s", 1.0)
    assert none.models.count() == 0 and none.whole == {}


def summary(g, columns, statistics, n=30):
    first = g.sort_values("k").head(n)
    of = {"median": lambda x: x.median(), "std": lambda x: x.std(ddof=0), "p10": lambda x: np.percentile(x, 10), "p90": lambda x: np.percentile(x, 90), "delta": lambda x: x.iloc[-1] - x.iloc[0]}
    return np.array([of[s](first[c]) for s in statistics for c in columns]), first


@pytest.mark.parametrize("shared", [None, "A"])
def test_two_level_models_without_each_session(spark, shared):
    p, names, rich = frame(6), ["f", "g"], ["f", "h"]
    df = spark.createDataFrame(p).repartition(3)
    refs, bounds = {"MAP": "ref_MAP", "PP": "ref_PP"}, {"PP": (45.0, 55.0)}
    out = baseline.held_out(df, names, refs, "s", "k", "method", baseline.STATISTICS, rich, shared, shrinkage=0.7, bounds=bounds).toPandas()
    assert len(out) == len(p) and out.PP_replaced.any() and not out.PP_replaced.all()
    for m in "AB":
        for s in range(6):
            base = p[p.method == (shared or m)]
            train = [t for t in range(6) if t != s]
            sums = {t: summary(base[base.s == t], rich, baseline.STATISTICS) for t in train}
            own, first = summary(p[(p.method == m) & (p.s == s)], rich, baseline.STATISTICS)
            for t, ref in refs.items():
                anchors = {k: v[1][ref].median() for k, v in sums.items()}
                coef, _ = ridge(np.stack([sums[k][0] for k in train]), np.array([anchors[k] for k in train]), 10.0)
                population = np.mean(list(anchors.values()))
                level = population + 0.7 * (coef[0] + coef[1:] @ own - population)
                low, high = bounds.get(t, (-np.inf, np.inf))
                level = level if low <= level <= high else population
                xs, ys = [], []
                for k in train:
                    g = p[(p.method == m) & (p.s == k)]
                    med = g.sort_values("k").head(30)[names].median()
                    xs.append((g[names] - med).to_numpy())
                    ys.append((g[ref] - anchors[k]).to_numpy())
                change, _ = ridge(np.concatenate(xs), np.concatenate(ys), 1.0)
                test = p[(p.method == m) & (p.s == s)].sort_values("k")
                want = level + change[0] + (test[names] - first[names].median()).to_numpy() @ change[1:]
                got = out[(out.method == m) & (out.s == s)].sort_values("k")
                assert np.allclose(got[f"{t}_baseline"], level, rtol=1e-6) and np.allclose(got[f"{t}_heldout"], want, rtol=1e-6)


def test_two_level_models_need_other_sessions(spark):
    df = spark.createDataFrame(frame(2))
    out = baseline.held_out(df, ["f"], {"PP": "ref_PP"}, "s", "k", "method")
    assert out.where("PP_heldout is not null").count() == 0 and out.count() == df.count()


def test_candidates_use_each_folds_own_features(spark):
    p = frame(4)
    names, n = ["f", "g", "h"], 1
    df = spark.createDataFrame(p[p.method == "A"]).withColumn("ok", F.col("k") % 7 != 0)
    out, models = projection.candidates(df, ["f"], ["g", "h"], "ref_PP", "pred_PP", "s", ["k"], F.col("ok"), n, smoothing=1.0)
    got, models, p = out.toPandas().sort_values(["s", "k"]), models.toPandas(), p[(p.method == "A") & (p.k % 7 != 0)]
    assert len(got) == len(p)
    centre = lambda c: p[c] - p.groupby("s")[c].transform("median")
    x, y = pd.DataFrame({c: centre(c) for c in names}), centre("ref_PP") - centre("pred_PP")
    for s in range(4):
        train, test = p.s != s, p.s == s
        strength = sorted(((abs(np.corrcoef(p[train][c], p[train].ref_PP)[0, 1]), c) for c in ("g", "h")), reverse=True)
        for name, use in (("a", names), ("b", ["f", *[c for _, c in strength[:n]]])):
            coef, z = ridge(x[train][use].to_numpy(), y[train].to_numpy(), 4.0)
            want = np.clip(p[test].pred_PP + coef[0] + x[test][use].to_numpy() @ coef[1:], 15, 100)
            assert np.allclose(got[got.s == s][f"candidate_{name}"], want, rtol=1e-7)
            own = models[(models.held_out == s) & (models.candidate == name)].set_index("feature").coefficient
            assert np.allclose([own[c] for c in ["intercept", *use]], z, rtol=1e-6)
