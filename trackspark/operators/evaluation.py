"""Evaluation tables: whole statistics per method and series, per session and over all, with rows for empty groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..functions.statistics import amplitude_ratio, mae, pearson, rmse, same_sign, tracking_gain
from ..shared import cut
from .folds import joined
from .metrics import on_grid

TARGETS = {t: (f"ref_{t}", f"pred_{t}") for t in ("SBP", "DBP", "MAP", "PP")}
ALL = "ALL"


def calibrated(x: Column, offset: float = 0.0, slope: float = 1.0) -> Column:
    """offset + slope * x; as it stands the identity."""
    return F.lit(offset) + slope * x


def wide_errors(df: DataFrame, keys: Sequence[str], session: str | None = None) -> DataFrame:
    """n, and mae, rmse, bias and corr of each of the four targets, in columns: 17 statistics a group of
    rows in which all is there. With session also per session, and as session ALL over all of them,
    from grouping sets over one scan."""
    whole = df.dropna(subset=[c for pair in TARGETS.values() for c in pair])
    out: list[Column] = [F.count("*").alias("n")]
    for t, (r, p) in TARGETS.items():
        e = F.col(p) - F.col(r)
        out += [mae(e).alias(f"{t}_mae"), rmse(e).alias(f"{t}_rmse"), F.avg(e).alias(f"{t}_bias"), pearson(F.col(p), F.col(r)).alias(f"{t}_corr")]
    if session is None:
        return whole.groupBy(*keys).agg(*out)
    sets = [[F.col(k) for k in (*keys, session)], [F.col(k) for k in keys]]
    each = whole.groupingSets(sets, *keys, session).agg(F.grouping(session).alias("__all"), *out)
    return each.withColumn(session, F.when(F.col("__all") == 1, F.lit(ALL)).otherwise(F.col(session).cast("string"))).drop("__all")


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], accuracy: int = 10000) -> DataFrame:
    """keys and the median of each of columns, for a few groups that may be any part of all rows.

    A sketch brackets the middle, from which it is off by one part in accuracy at most; rows below
    the bracket are counted, and only the distinct values within it are put in order. All columns go
    through the two scans of df together, and no row of it is shuffled: brackets, a row per group, go to all
    tasks. Missing values don't count; a group without values has null."""
    step, by, named = 2 / accuracy, [*keys, "__c"], [f"__x{k}" for k in range(len(columns))]
    rows = df.select(*keys, *[F.col(c).cast("double").alias(x) for c, x in zip(columns, named, strict=True)])
    at = F.array(F.lit(0.5 - step), F.lit(0.5 + step))
    bracket = rows.groupBy(*keys).agg(*[F.count(x).alias(f"__n{k}") for k, x in enumerate(named)], *[F.percentile_approx(x, at, accuracy).alias(f"__b{k}") for k, x in enumerate(named)])
    value = [F.when(F.col(x) <= F.col(f"__b{k}")[1], F.struct(F.lit(k).alias("__c"), F.col(f"__n{k}").alias("__n"), F.when(F.col(x) >= F.col(f"__b{k}")[0], F.col(x)).alias("__v"))) for k, x in enumerate(named)]
    some = joined(rows, F.broadcast(bracket), keys, "inner").select(*keys, F.explode(F.array(*value)).alias("__e")).where("__e is not null").select(*keys, "__e.*")
    # one row per distinct value in the bracket, and one (null) for all below it
    sums = some.groupBy(*by, "__n", "__v").agg(F.count("*").alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy(*by).orderBy(F.col("__v").asc_nulls_first()))
    sums = sums.withColumn("__upto", upto)
    hits = [F.min(F.when(F.col("__upto") >= F.floor((F.col("__n") + k) / 2), F.col("__v"))) for k in (1, 2)]
    found = sums.groupBy(*by).agg(((hits[0] + hits[1]) / 2).alias("__m"))
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("__c") == k, F.col("__m"))).alias(c) for k, c in enumerate(columns)])
    return joined(bracket.select(*keys), found, keys)


#: Sums over rows of a session from which the measures of pooled sessions are made.
_SUMS = ("abs", "sq", "err", "mabs", "msq", "r", "p", "rr", "pp", "rp", "same", "same_n", "steps", "steps_n", "whole", "map", "map_abs", "pulse", "pulse_abs")
_ENDS = ("first_ref", "first_pred", "last_ref", "last_pred")


def _agreeing(a: Column, b: Column) -> Column:
    """1.0 where signs are equal, 0.0 where they are not; null where one is 0 or missing."""
    return F.when((a != 0) & (b != 0), (F.signum(a) == F.signum(b)).cast("double"))


def _of_sessions(df: DataFrame, series: Mapping[str, Mapping[str, Column]], order: Sequence[str], session: str, method: str, middle: DataFrame | None) -> DataFrame:
    """A row for each session, method, series and target of df, also where n is 0: n, all measures, the
    errors beside them and, with middle (pooled medians), sums and the rows at both ends.

    Rows stay as wide as df until they are sorted; targets and series part in the task that sums them, so
    a row is shuffled once, and not at all if df lies by session."""
    c, keys = F.col, [session, method]
    at = {(s, t): (moved.get(r, c(r)), moved.get(p, c(p))) for s, moved in series.items() for t, (r, p) in TARGETS.items()}
    sides = {}
    for k, (r, p) in enumerate(at.values()):
        known = r.isNotNull() & p.isNotNull()
        sides |= {f"__r{k}": F.when(known, r.cast("double")), f"__p{k}": F.when(known, p.cast("double"))}
    ordered = Window.partitionBy(*keys).orderBy(*order)
    before, group = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    rows = df.select(*keys, *order, *[x.alias(n) for n, x in sides.items()])
    rows = rows.withColumns({"__place": F.row_number().over(ordered).cast("long"), **{f"__s{n}": c(n) - F.last(n, ignorenulls=True).over(before) for n in sides}})
    rows = rows.withColumns({f"__c{n}": c(n) - F.median(n).over(group) for n in sides})
    if middle is not None:
        rows = joined(rows, F.broadcast(middle.withColumnsRenamed({n: f"__m{n}" for n in sides})), [method])
    each, places = [], {name: k for k, name in enumerate(at)}
    for (s, t), k in places.items():
        whole = None
        for other in TARGETS:
            there = c(f"__r{places[s, other]}").isNotNull()
            whole = there if whole is None else whole & there
        beside = {n: F.when(whole, c(f"__p{places[s, o]}") - c(f"__r{places[s, o]}")) for n, o in (("map", "MAP"), ("pulse", "PP"))}
        r, p = f"__r{k}", f"__p{k}"
        columns = {"ref": c(r), "pred": c(p), "r": c(f"__c{r}"), "p": c(f"__c{p}"), "rs": c(f"__s{r}"), "ps": c(f"__s{p}"), **beside}
        if middle is not None:
            columns |= {"mr": c(r) - c(f"__m{r}"), "mp": c(p) - c(f"__m{p}")}
        each.append(F.struct(F.lit(s).alias("series"), F.lit(t).alias("target"), *[x.alias(n) for n, x in columns.items()]))
    rows = rows.select(*keys, "__place", F.explode(F.array(*each)).alias("__e")).select(*keys, "__place", "__e.*")
    error, moved, gain = c("pred") - c("ref"), c("p") - c("r"), tracking_gain(c("r"), c("p"))
    out = [
        F.count("ref").alias("n"), mae(error).alias("mae"), rmse(error).alias("rmse"), pearson(c("pred"), c("ref")).alias("corr"), F.avg(error).alias("signed_bias"),
        mae(moved).alias("centered_mae"), rmse(moved).alias("centered_rmse"), pearson(c("p"), c("r")).alias("centered_corr"), gain.alias("tracking_gain"),
        amplitude_ratio(c("r"), c("p")).alias("amplitude_ratio"), same_sign(c("rs"), c("ps")).alias("direction_agreement"), mae(c("ps") - c("rs")).alias("delta_mae"),
        *[f(x).alias(f"{n}_{m}") for n, x in (("map", c("map")), ("pp", c("pulse"))) for m, f in (("mae", mae), ("signed_bias", F.avg))],
    ]
    if middle is not None:
        a, b, agreeing, steps = c("mr"), c("mp"), _agreeing(c("rs"), c("ps")), F.abs(c("ps") - c("rs"))
        summed = [F.abs(error), error * error, error, F.abs(b - a), (b - a) * (b - a), a, b, a * a, b * b, a * b, agreeing, None, steps, None, None, c("map"), F.abs("map"), c("pulse"), F.abs("pulse")]
        counted = {"same_n": agreeing, "steps_n": steps, "whole": c("map")}
        out += [(F.count(counted[n]) if n in counted else F.sum(x)).alias(f"__{n}") for n, x in zip(_SUMS, summed, strict=True)]
        place = F.when(c("ref").isNotNull(), c("__place"))
        out += [f(side, place).alias(f"__{end}_{side}") for end, f in (("first", F.min_by), ("last", F.max_by)) for side in ("ref", "pred")]
    return rows.groupBy(*keys, "series", "target").agg(*out)


def _pooled(each: DataFrame, session: str, method: str) -> DataFrame:
    """Measures of all sessions together, from their sums: the first step of a session goes from the last
    row of the session before."""
    c, keys = F.col, [method, "series", "target"]
    some = each.where("n > 0")
    last = Window.partitionBy(*keys).orderBy(c(session).asc_nulls_last())
    some = some.withColumns({f"__{s}": c(f"__first_{s}") - F.lag(f"__last_{s}").over(last) for s in ("ref", "pred")})
    agreeing, step = _agreeing(c("__ref"), c("__pred")), F.abs(c("__pred") - c("__ref"))
    more = {"same": F.coalesce(agreeing, F.lit(0.0)), "same_n": agreeing.isNotNull().cast("long"), "steps": F.coalesce(step, F.lit(0.0)), "steps_n": step.isNotNull().cast("long")}
    some = some.withColumns({f"__{n}": F.coalesce(c(f"__{n}"), F.lit(0)) + x for n, x in more.items()})
    total = some.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"__{n}").alias(f"__{n}") for n in _SUMS])

    def mean(name: str, by: str = "n") -> Column:
        return F.try_divide(c(f"__{name}"), c(by))

    def spread(x: str, y: str) -> Column:
        return c(f"__{x}{y}") - c(f"__{x}") * c(f"__{y}") / c("n")

    deviation = {x: F.sqrt(F.greatest(spread(x, x), F.lit(0.0))) for x in "rp"}
    corr = F.when(c("n") >= 2, safe_divide(spread("r", "p"), deviation["r"] * deviation["p"]))
    out = {
        "mae": mean("abs"), "rmse": F.sqrt(mean("sq")), "corr": corr, "signed_bias": mean("err"), "centered_mae": mean("mabs"), "centered_rmse": F.sqrt(mean("msq")), "centered_corr": corr,
        "tracking_gain": safe_divide(c("__rp"), c("__rr")), "amplitude_ratio": safe_divide(deviation["p"], deviation["r"]), "direction_agreement": mean("same", "__same_n"), "delta_mae": mean("steps", "__steps_n"),
        "map_mae": mean("map_abs", "__whole"), "map_signed_bias": mean("map", "__whole"), "pp_mae": mean("pulse_abs", "__whole"), "pp_signed_bias": mean("pulse", "__whole"),
    }
    return total.select(*keys, "n", *[x.alias(n) for n, x in out.items()])


def measured(df: DataFrame, series: Mapping[str, Mapping[str, Column]], order: Sequence[str], session: str = "session_id", method: str = "method", totals: bool = True, keep: bool = False) -> DataFrame:
    """session (as text), method, series, target, n, all measures and the errors of mean and pulse pressure,
    of df (session, method, order, ref_* and pred_*); rows with n = 0 for what df has without any pair.

    With totals also rows of session ALL, which pool sessions: they are centred on the pooled median, and steps
    go across the borders of sessions. df is read three times then, twice of them only for method, ref_* and
    pred_*; without totals once. What is kept is a row per session, method, series and target (with keep also
    without totals, for those who read the result more than once)."""
    middle = None
    if totals:
        sides = [(moved.get(r, F.col(r)), moved.get(p, F.col(p))) for moved in series.values() for r, p in TARGETS.values()]
        known = [(k, s, F.when(r.isNotNull() & p.isNotNull(), x)) for k, (r, p) in enumerate(sides) for s, x in (("r", r), ("p", p))]
        wide = df.select(method, *[x.cast("double").alias(f"__{s}{k}") for k, s, x in known])
        middle = exact_medians(wide, [method], [f"__{s}{k}" for k, s, _ in known])
    each = _of_sessions(df, series, order, session, method, middle)
    each = cut(each) if totals or keep else each  # read several times
    out = each.drop(*[f"__{n}" for n in (*_SUMS, *_ENDS)]).withColumn(session, F.col(session).cast("string"))
    if totals:
        out = out.unionByName(_pooled(each, session, method).withColumn(session, F.lit(ALL)))
    return out.withColumn("inversion_like", ((F.col("target") == "PP") & F.coalesce(F.col("tracking_gain") < 0, F.lit(False))).cast("int"))


def session_style(df: DataFrame, series: Mapping[str, Mapping[str, Column]], order: Sequence[str], session: str = "session_id", method: str = "method", totals: bool = True, grid: DataFrame | None = None) -> DataFrame:
    """session, method, series, target and all measures, and the errors of mean and pulse pressure beside
    them, of df (session, method, ref_* and pred_*).

    series gives, for each series, columns that replace predictions (none: as they are). With totals
    also rows of session ALL, which pool sessions. Each session has a row for each method, series and
    target that there are in df, or in grid (session, method); without data n is 0 and measures are null."""
    keys = [session, method, "series", "target"]
    out = measured(df, series, order, session, method, totals, keep=grid is None)
    if grid is None:
        own = out.where((F.col("series") == next(iter(series))) & (F.col("target") == next(iter(TARGETS))))
        names = own.select(method).distinct()
        grid = own.select(session).distinct().join(F.broadcast(names), F.lit(True))  # one row per session and method
    grid = grid.select(F.col(session).cast("string").alias(session), method).distinct()
    if totals:
        grid = grid.union(grid.select(F.lit(ALL).alias(session), method)).distinct()
    names = F.explode(F.array(*map(F.lit, series))).alias("series")
    grid = grid.select("*", names).withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
    return on_grid(out.where("n > 0"), grid, keys)
