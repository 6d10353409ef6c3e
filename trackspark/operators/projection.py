"""Leave-one-session-out projections of centred series: tracking projection and pulse candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from ..functions.statistics import pearson
from ..shared import cut
from . import folds
from .features import centered, design
from .frames import unpivoted
from .smooth import smoothed

DESIGN = ["x_centered", "x_delta", "x_highpass", "x_accel", "c_centered", "c_delta"]


#: Parts of the predicted course, by target, where a method has none of its own.
BLENDS = {"MAP": 0.70, "PP": 0.88}


def projected(df: DataFrame, blends: Mapping[str, Mapping[str, float]], session: str, order: Sequence, method: str = "method", least_rows: int = 120, least_sessions: int = 2, low: float = 15.0, high: float = 100.0, alpha: float = 3.0, least_fold: int = 40) -> DataFrame:
    """df (method, session, ref_MAP, ref_PP, pred_*) with mean and pulse pressure of the methods in blends
    projected, each method by itself: the session's median of the prediction, plus blend parts of the
    centred reference that other sessions' dynamics predict and 1 - blend parts of the centred prediction.
    Sessions whose fold has fewer than least_fold rows, and rows without all features, keep their
    prediction. Pulse pressure is held between low and high, and systolic and diastolic pressure come from
    both. blends: parts by target of each method. Methods with fewer than least_rows rows or least_sessions
    sessions with complete rows stay as they are, and so do all others. df is read three times, so it had
    better be a table; if it lies by session, its rows aren't shuffled."""
    some = df.where(F.col(method).isin(list(blends)))
    keys = [method, session]
    for t, other in (("MAP", "PP"), ("PP", "MAP")):
        some = design(some, f"pred_{t}", f"pred_{other}", keys, order)
        some = some.withColumnsRenamed({c: f"__{t}_{c}" for c in DESIGN}).withColumn(f"__{t}_y", centered(F.col(f"ref_{t}"), keys))
    per = {t: {**{c: F.col(f"__{t}_{c}") for c in DESIGN}, "y": F.col(f"__{t}_y")} for t in BLENDS}
    each = folds.moments(unpivoted(some, keys, per, "target"), [F.col(c) for c in DESIGN], F.col("y"), [method, "target", session])
    models = folds.leave_one_out(each, session, alpha, [method, "target"], least_fold)
    # groups of too few rows or sessions are known from the sums
    known = [(*k, m.rows, m.sessions) for k, m in models.whole.items()]
    weak = sorted({name for name, _, rows, sessions in known if rows < least_rows or sessions < least_sessions})
    coefficients = cut(models.models.select(*keys, "target", "coef"))
    some = folds.looked_up(some, coefficients, session, {f"__{t}_own": {method: F.col(method), "target": F.lit(t)} for t in BLENDS})
    for t in BLENDS:
        part = F.coalesce(*[F.when(F.col(method) == name, F.lit(float(b.get(t, BLENDS[t])))) for name, b in blends.items()])
        x = F.col(f"__{t}_x_centered")
        hat = folds.dot(F.col(f"__{t}_own")["coef"], [F.col(f"__{t}_{c}") for c in DESIGN])
        value = F.coalesce(F.col(f"pred_{t}") - x + part * hat + (1 - part) * x, F.col(f"pred_{t}"))
        some = some.withColumn(f"__{t}", value)
    m, p = F.col("__MAP"), clamp(F.col("__PP"), low, high)
    new = {"pred_MAP": m, "pred_PP": p, "pred_DBP": m - p / 3, "pred_SBP": m - p / 3 + p}
    stays = F.col(method).isin(weak) if weak else F.lit(False)
    some = some.withColumns({c: F.when(stays, F.col(c)).otherwise(x) for c, x in new.items()})
    rest = df.where(~F.coalesce(F.col(method).isin(list(blends)), F.lit(False)))
    return rest.unionByName(some.select(df.columns))


def leading_features(df: DataFrame, features: Sequence[str], ref: str, session: str, n: int = 6, least: int = 3) -> DataFrame:
    """held_out, place, feature, strength: per fold the n features with the strongest correlation with
    ref in the other sessions (ties to the later name). Correlations don't change when both series are
    centred on one value, so sums per session and feature do for all folds."""
    rows = unpivoted(df, [session, ref], {f: {"value": F.col(f).cast("double")} for f in features}, "feature").where(f"value is not null and {ref} is not null")
    x, y = F.col("value"), F.col(ref).cast("double")
    each = rows.groupBy(session, "feature").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in dict(x=x, y=y, xx=x * x, yy=y * y, xy=x * y).items()])
    parts = ("n", "x", "y", "xx", "yy", "xy")
    every = each.groupBy("feature").agg(*[F.sum(k).alias(f"t_{k}") for k in parts])
    held = df.select(F.col(session).alias("held_out")).distinct()
    own = each.withColumnRenamed(session, "held_out")
    # sessions x features rows, small beside the data
    rest = held.join(every, F.lit(True)).join(own, ["held_out", "feature"], "left")
    rest = rest.select("held_out", "feature", *[(F.col(f"t_{k}") - F.coalesce(k, F.lit(0))).alias(k) for k in parts]).where(F.col("n") >= least)
    c = F.col
    r = F.try_divide(c("n") * c("xy") - c("x") * c("y"), F.sqrt(F.greatest((c("n") * c("xx") - c("x") * c("x")) * (c("n") * c("yy") - c("y") * c("y")), F.lit(0.0))))
    rest = rest.withColumn("strength", F.abs(r)).where("strength is not null")
    w = Window.partitionBy("held_out").orderBy(F.desc("strength"), F.desc("feature"))
    return rest.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("held_out", "place", "feature", "strength")


def candidates(df: DataFrame, first: Sequence[str], others: Sequence[str], ref: str, base: str, session: str, order: Sequence, valid: Column | None = None, n: int = 6, alpha: float = 4.0, low: float = 15.0, high: float = 100.0, smoothing: float = 0.42) -> tuple[DataFrame, DataFrame]:
    """Two corrected courses of base, and their models.

    A correction is what other sessions' centred features predict for the centred difference of ref and
    base; base plus the correction is clipped, smoothed and clipped again. candidate_a uses all features,
    candidate_b the first ones and those n of the others that correlate most strongly with ref in the
    other sessions (leading_features; the first n if none does): each fold has its own, all from one
    matrix of sums. The rows are the valid ones of df (valid null: not valid) with ref, base and all
    features; a fold that lacks rows leaves null. Models: held_out, candidate, feature, coefficient (on
    standardised features; the intercept is the mean)."""
    names = [*first, *others]
    rows = df if valid is None else df.where(valid)
    rows = rows.dropna(subset=[ref, base, *names])
    rows = rows.withColumns({f"__{f}": centered(F.col(f).cast("double"), [session]) for f in names})
    rows = cut(rows.withColumn("__y", centered(F.col(ref), [session]) - centered(F.col(base), [session])))
    each = folds.moments(rows, [F.col(f"__{f}") for f in names], F.col("__y"), [session])
    place = F.create_map(*[F.lit(x) for k, f in enumerate(names) for x in (f, k)])
    lead = leading_features(rows, list(others), ref, session, n).groupBy(F.col("held_out").alias(session)).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "feature"))), lambda x: place[x["feature"]]).alias("lead"))
    default = F.array(*map(F.lit, range(len(first), len(first) + min(n, len(others)))))
    picks = folds.joined(each, lead, [session])
    picks = picks.withColumn("pick", F.concat(F.array(*map(F.lit, range(len(first)))).cast("array<int>"), F.coalesce("lead", default))).drop("lead")
    models, values = {"a": folds.leave_one_out(each, session, alpha).models, "b": folds.leave_one_out(picks, session, alpha).models}, [F.col(f"__{f}") for f in names]
    listed = []
    for name, m in models.items():
        found = m.select(session, F.col("coef").alias("__coef"), F.col("pick").alias("__pick"))
        rows = folds.joined(rows, found, [session]).withColumn("__p", clamp(F.col(base) + folds.picked(F.col("__coef"), F.col("__pick"), values), low, high))
        rows = smoothed(rows.drop("__coef", "__pick"), {"__s": F.col("__p")}, smoothing, [session], order)
        rows = rows.withColumn(f"candidate_{name}", clamp(F.col("__s"), low, high)).drop("__p", "__s")
        terms = F.zip_with(F.zip_with(F.slice("coef", F.lit(2), F.size("pick")), "scale", lambda c, s: c * s), "pick", lambda z, k: F.struct(F.get(F.array(*map(F.lit, names)), k).alias("feature"), z.alias("coefficient")))
        whole = F.concat(F.array(F.struct(F.lit("intercept").alias("feature"), F.col("mean_y").alias("coefficient"))), terms)
        listed.append(m.select(F.col(session).alias("held_out"), F.lit(name).alias("candidate"), F.explode(whole).alias("t")).select("held_out", "candidate", "t.*"))
    return rows.drop("__y", *[f"__{f}" for f in names]), listed[0].unionByName(listed[1])


def fold_correlation(df: DataFrame, pred: str, ref: str, session: str) -> DataFrame:
    """Correlation of predictions with the reference in each held-out session."""
    return df.groupBy(session).agg(F.count("*").alias("n"), pearson(F.col(pred), F.col(ref)).alias("corr"))
