"""Grid search of lag, sign and gain that aligns a predicted with a reference course, per group.

It fits to the reference itself, so its result is an upper bound of tracking, not an estimate. Scores are
correlations of steps. All that they need of a candidate are the moments of the steps of the course at
its lag, so these are summed once per group and lag, and signs and gains are worked out from them: in a
correlation a sign only turns, and a gain drops out, unless another course is added."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .folds import looked_up

TARGETS = ("MAP", "PP", "SBP", "DBP")


@dataclass(frozen=True)
class Search:
    """Fixed values of a search; candidates are tried in this order, the first of equals wins."""

    lags: tuple[int, ...] = (-6, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6)
    signs: tuple[float, ...] = (1.0, -1.0)
    gains: tuple[float, ...] = (0.7, 0.85, 1.0, 1.15, 1.3)
    weights: tuple[float, float, float] = (0.4, 0.3, 0.3)  # pulse, systolic, diastolic
    calibration: int = 8
    reliable: float = 0.45
    blend: float = 1.0

    def grid(self) -> Column:
        """Candidates as array<struct<lag, sign, gain>>."""
        return F.array(*[F.struct(F.lit(lag).alias("lag"), F.lit(float(sign)).alias("sign"), F.lit(float(gain)).alias("gain")) for lag in self.lags for sign in self.signs for gain in self.gains])


def _correlation(xy: Column, xx: Column, yy: Column, n: Column) -> Column:
    """Null where fewer than three steps are known on both sides, or one side has no spread."""
    return F.when((n >= 3) & (xx > 1e-24) & (yy > 1e-24), xy / F.sqrt(xx * yy))


def _moments(steps: dict[str, Column], within: Column) -> Column:
    """A struct of the number, variances and covariances of steps over rows within in which all are known."""
    known = within
    for x in steps.values():
        known = known & x.isNotNull()
    at = {k: F.when(known, x) for k, x in steps.items()}
    names = list(at)
    return F.struct(F.count_if(known).alias("n"), *[F.covar_pop(at[a], at[b]).alias(f"{a}{b}") for i, a in enumerate(names) for b in names[i:]])


def _chosen(grid: Column, near: Callable[[Column], Column], wide: Callable[[Column], Column], reliable: Column) -> Column:
    """The first candidate with the highest score near, or, if that is below reliable and the highest
    score wide is higher, the first with that; null if no score is known. Scores count to nine digits,
    as gains hardly change them."""

    def best(score: Callable[[Column], Column]) -> Column:
        rated = F.transform(grid, lambda c, k: F.struct(F.round(score(c), 9).alias("score"), (-k).alias("k"), c.alias("c")))
        return F.array_max(F.filter(rated, lambda x: x["score"].isNotNull()))

    both = F.struct(best(near).alias("near"), best(wide).alias("wide"))

    def pick(b: Column) -> Column:
        n, w = b["near"], b["wide"]
        further = w.isNotNull() & (n.isNull() | (n["score"] < reliable) & (w["score"] > n["score"]))
        return F.when(further, w["c"]).otherwise(n["c"])

    return F.transform(F.array(both), pick)[0]


def aligned(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], method: str | None = None, searches: dict[str, Search] | None = None, default: Search = Search()) -> DataFrame:
    """df (ref_MAP, ref_PP, ref_SBP, ref_DBP, pred_MAP, pred_PP, pred_SBP, pred_DBP) with predictions
    aligned, and map_lag, map_sign, map_gain, pp_lag, pp_sign, pp_gain. Mean pressure is searched
    first, then pulse pressure by the weighted scores of what both give. A course at a lag is what it
    was lag rows before (itself where that is missing), turned and stretched about its median in the
    group. Groups of under four rows stay.

    df is kept by the first of keys, which is its one shuffle, if it doesn't lie so yet; a group is read by
    windows, row by row, so it may be long."""
    searches, orders = searches or {}, [order] if isinstance(order, str) else list(order)
    every = {None: default, **searches}
    reach = sorted({lag for s in every.values() for lag in s.lags} | {0})

    def per(value: Callable[[Search], Column]) -> Column:
        """What the search of a row's method says."""
        cases = [F.when(F.col(method) == m, value(s)) for m, s in searches.items()] if method else []
        return F.coalesce(*cases, value(default))

    # rows are read by each search and by what takes its choice, and lie by the first key all the while
    df, first, others = cut(df, keys[0]), keys[0], [k for k in keys[1:]]
    group, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*orders)
    rows = df.withColumns({f"{s}_{t}": F.col(f"{s}_{t}").cast("double") for s in ("ref", "pred") for t in TARGETS})
    at = {"__place": F.row_number().over(ordered)}
    for t in ("MAP", "PP"):
        x = F.col(f"pred_{t}")
        at[f"__{t}"] = F.array(*[F.coalesce(F.lag(x, lag).over(ordered) if lag >= 0 else F.lead(x, -lag).over(ordered), x) for lag in reach])
    at |= {f"__goal_{t}": F.col(f"ref_{t}") - F.lag(f"ref_{t}").over(ordered) for t in TARGETS}
    rows = rows.withColumns(at)
    rows = rows.withColumns({f"__step_{t}": F.zip_with(F.col(f"__{t}"), F.lag(f"__{t}").over(ordered), lambda a, b: a - b) for t in ("MAP", "PP")})
    rows = rows.withColumns({"__rows": F.count("*").over(group), **{f"__middle_{t}": F.coalesce(F.median(f"pred_{t}").over(group), F.lit(0.0)) for t in ("MAP", "PP")}})
    rows = rows.withColumns({"__near": F.least(per(lambda s: F.lit(s.calibration)), F.col("__rows"))})
    long = F.col("__rows") >= 4
    spans = {"near": long & (F.col("__near") >= 4) & (F.col("__place") <= F.col("__near")), "wide": long}
    index = {lag: k for k, lag in enumerate(reach)}
    lags = F.array(*[F.lit(lag) for lag in reach])
    own_method = [] if method is None or method in keys else [F.max(F.when(F.col("__place") == 1, F.col(method))).alias(method)]

    def summed(names: Sequence[str], steps: dict[str, dict[str, Column]]) -> DataFrame:
        """A row for each group: keys, the first row's method, and a map lag -> moments of each set of steps in either span."""
        kept = [*names, *([method] if own_method else [])]
        some = rows.select(*keys, *kept, "__place", "__rows", "__near", F.posexplode(lags).alias("__k", "__lag"))
        parts = [_moments(s, within).alias(f"{name}_{span}") for name, s in steps.items() for span, within in spans.items()]
        some = some.groupBy(*keys, "__lag").agg(F.first("__rows").alias("__rows"), *own_method, *parts)
        entry = F.struct("__lag", F.struct(*[f"{n}_{s}" for n in steps for s in spans]))
        return some.groupBy(*keys).agg(F.first("__rows").alias("__rows"), *[F.max(method).alias(method) for _ in own_method], F.map_from_entries(F.collect_list(entry)).alias("__m"))

    b = {t: F.get(F.col(f"__step_{t}"), F.col("__k")) for t in ("MAP", "PP")}
    grid, still = per(lambda s: s.grid()), F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("sign"), F.lit(1.0).alias("gain"))

    def simple(name: str, span: str) -> Callable[[Column], Column]:
        def score(c: Column) -> Column:
            m = F.element_at("__m", c["lag"])[f"{name}_{span}"]
            return c["sign"] * _correlation(m["br"], m["bb"], m["rr"], m["n"])

        return score

    def found(name: str, moments: DataFrame, score: Callable[[str], Callable[[Column], Column]]) -> DataFrame:
        """rows with the candidate that each group takes, decided by its moments."""
        choice = _chosen(grid, score("near"), score("wide"), per(lambda s: F.lit(float(s.reliable))))
        choice = F.coalesce(F.when(long, choice), still)
        taken = cut(moments.select(*keys, choice.alias("__c")).select(*keys, "__c.*"))
        return looked_up(rows, taken, first, {f"__{name}": {k: F.col(k) for k in others}})

    rows = found("one", summed(["__step_MAP", "__goal_MAP"], {"m": {"b": b["MAP"], "r": F.col("__goal_MAP")}}), lambda span: simple("m", span))
    place = F.create_map(*[F.lit(x) for lag, k in index.items() for x in (lag, k)])

    def taken(name: str, t: str, values: Column) -> Column:
        return F.get(values, place[F.col(f"__{name}")["lag"]])

    one = F.col("__one")
    rows = rows.withColumn("__base", one["sign"] * one["gain"] * taken("one", "MAP", F.col("__step_MAP")))
    sets = {"p": {"b": b["PP"], "r": F.col("__goal_PP")}} | {k: {"a": F.col("__base"), "b": b["PP"], "r": F.col(f"__goal_{t}")} for k, t in (("s", "SBP"), ("d", "DBP"))}

    def mixed(span: str) -> Callable[[Column], Column]:
        def score(c: Column) -> Column:
            m, by = F.element_at("__m", c["lag"]), c["sign"] * c["gain"]
            each = [simple("p", span)(c)]
            for name, part in (("s", 2 / 3), ("d", -1 / 3)):
                v, w = m[f"{name}_{span}"], by * part
                each.append(_correlation(v["ar"] + w * v["br"], v["aa"] + 2 * w * v["ab"] + w * w * v["bb"], v["rr"], v["n"]))
            shares = [F.when(x.isNotNull(), per(lambda s, k=k: F.lit(float(s.weights[k])))).otherwise(0.0) for k, x in enumerate(each)]
            total = shares[0] + shares[1] + shares[2]
            return F.when(total > 0, sum((F.coalesce(x, F.lit(0.0)) * s for x, s in zip(each, shares, strict=True)), F.lit(0.0)) / total)

        return score

    rows = found("two", summed(["__step_PP", "__goal_PP", "__goal_SBP", "__goal_DBP", "__base"], sets), mixed)
    part = per(lambda s: F.lit(float(min(max(s.blend, 0.0), 1.0))))
    new = {}
    for name, t in (("one", "MAP"), ("two", "PP")):
        c, middle, x = F.col(f"__{name}"), F.col(f"__middle_{t}"), F.col(f"pred_{t}")
        turned = middle + c["sign"] * c["gain"] * (taken(name, t, F.col(f"__{t}")) - middle)
        new[t] = F.when(long, (1 - part) * x + part * F.coalesce(turned, x)).otherwise(x)
    m, p = new["MAP"], new["PP"]
    both = {"MAP": m, "PP": p, "SBP": m + 2 * p / 3, "DBP": m - p / 3}
    rows = rows.withColumns({f"__new_{t}": F.when(long, x).otherwise(F.col(f"pred_{t}")) for t, x in both.items()})
    out = [F.col(f"__new_{c[5:]}").alias(c) if c in {f"pred_{t}" for t in TARGETS} else F.col(c) for c in df.columns]
    return rows.select(*out, *[F.col(f"__{n}")[k].alias(f"{pre}_{k}") for n, pre in (("one", "map"), ("two", "pp")) for k in ("lag", "sign", "gain")])


def aligned_beats(df: DataFrame, name: str, order: str | Sequence[str], search: Search = Search()) -> DataFrame:
    """Beats of one method, aligned as windows are. Columns that place a beat are made up where they are
    missing: one session, and beat numbers and seconds by order. A frame without all four targets of
    both sides stays as it is."""
    if not {f"{s}_{t}" for s in ("ref", "pred") for t in TARGETS} <= set(df.columns):
        return df
    orders = [order] if isinstance(order, str) else list(order)
    made = {} if "session_id" in df.columns else {"session_id": F.lit("single")}
    rows = df.withColumns({**made, "__method": F.lit(name)})
    number = F.row_number().over(Window.partitionBy("session_id").orderBy(*orders))
    rows = rows.withColumns({c: x for c, x in {"elapsed_s": (number - 1).cast("double"), "beat_index": number}.items() if c not in df.columns})
    out = aligned(rows, ["session_id", "__method"], ["elapsed_s", "beat_index"], "__method", {name: search})
    return out.select(df.columns)
