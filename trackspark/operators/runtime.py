"""Predictions of stored models as columns: raw and clamped pressures, coefficients and terms of each method."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import diastolic, finite, number, plausible, systolic
from . import ridge
from .quality import valid_strict


@dataclass(frozen=True)
class Method:
    """A model whose columns begin with prefix: its features (columns; "square:column" for a square), the
    labels of their terms, the prefix of the method whose base prediction it corrects, if any, and the
    gap that its systolic pressure keeps above the diastolic (None: none)."""

    prefix: str
    features: tuple[str, ...]
    labels: tuple[str, ...]
    base: str | None = None
    gap: float | None = 20.0
    scales: tuple[tuple[str, float], ...] = ()


#: Features and terms of the three core methods, and the gains on terms of their pulse pressure.
CORE = (
    Method("M1", ("M1_A_used", "M1_HR_used", "M1_V2P_relTTP_used", "M1_P2V_relTTP_used"), ("A", "HR", "V2P_relTTP", "P2V_relTTP")),
    Method("M2", ("M2_A_used", "M2_HR_used", "M2_V2P_relTTP_used", "M2_P2V_relTTP_used", "M2_Stiffness_used", "M2_E_used"), ("A", "HR", "V2P_relTTP", "P2V_relTTP", "Stiffness", "E"), base="M1", scales=(("E", 0.65),)),
    Method("M3", ("M3_A_used", "M3_HR_used", "M3_Mean_used", "M3_sinPhi_used", "M3_cosPhi_used"), ("A", "HR", "Mean", "sinPhi", "cosPhi"), scales=(("sinPhi", 0.80),)),
)

#: The same of the three experimental methods, which stand by themselves.
EXPERIMENTAL = (
    Method("SinBP_D_EOnly", ("SinBP_D_EOnly_A_used", "M2_HR_used", "M2_V2P_relTTP_used", "M2_P2V_relTTP_used", "SinBP_D_EOnly_E_used"), ("A", "HR", "V2P_relTTP", "P2V_relTTP", "E"), scales=(("E", 0.65),)),
    Method("SinBP_D_E2", ("SinBP_D_E2_A_used", "M2_HR_used", "M2_V2P_relTTP_used", "M2_P2V_relTTP_used", "SinBP_D_E2_E_used", "square:SinBP_D_E2_E_used"), ("A", "HR", "V2P_relTTP", "P2V_relTTP", "E", "E2"), scales=(("E", 0.65), ("E2", 0.65))),
    Method("SinBP_D_LocalA", ("SinBP_D_LocalA_A_used", "M2_HR_used", "M2_V2P_relTTP_used", "M2_P2V_relTTP_used", "SinBP_D_LocalA_Stiffness_used", "SinBP_D_LocalA_E_used"), ("A_local", "HR", "V2P_relTTP", "P2V_relTTP", "Stiffness", "E"), scales=(("E", 0.65),)),
)
METHODS = (*CORE, *EXPERIMENTAL)


def feature(df: DataFrame, name: str) -> Column:
    """A feature column as a finite number; null where it isn't one, or there is no such column."""
    square, _, column = name.rpartition(":")
    x = number(F.col(f"`{column}`")) if column in df.columns else F.lit(None).cast("double")
    return x * x if square == "square" else x


def predicted(df: DataFrame, method: Method, model: Mapping[str, Sequence[float]], methods: Mapping[str, Method], models: Mapping[str, Mapping]) -> dict[str, Column]:
    """The columns of one method, null on rows that aren't valid or lack a feature of it or of its base.
    model has the coefficients MAP and PP, and may have pp_term_scales."""
    p, xs = method.prefix, [feature(df, f) for f in method.features]
    ready = finite(*xs)
    if method.base:
        base = methods[method.base]
        own = [feature(df, f) for f in base.features]
        ready = ready & finite(*own)
    if f"{p}_output_valid" in df.columns:
        ready = ready & valid_strict(F.col(f"{p}_output_valid"), F.col(f"{p}_reject_reason"))
    scales = dict(model.get("pp_term_scales") or method.scales)
    coef = {"MAP": [float(c) for c in model["MAP"]], "PP": ridge.scaled(model["PP"], method.labels, scales).tolist()}
    values, labels = [F.lit(1.0), *xs], ("intercept", *method.labels)

    def total(c: Sequence[float], over: Sequence[Column]) -> Column:
        return sum((b * x for b, x in zip(c, over, strict=True)), F.lit(0.0))

    raw = {t: F.when(ready, total(c, values)) for t, c in coef.items()}
    s, d = systolic(raw["MAP"], raw["PP"]), diastolic(raw["MAP"], raw["PP"])
    held = plausible(s, d, method.gap)
    out = {f"{p}_{t}_model_raw": x for t, x in raw.items()}
    out |= {f"{p}_{t}{k}": x for t, x in zip(("SBP", "DBP"), held, strict=True) for k in ("", "_raw")}
    for k, label in enumerate(labels):
        m, q = coef["MAP"][k], coef["PP"][k]
        out |= {f"{p}_{t}_coef_{label}": F.when(ready, F.lit(v)) for t, v in (("MAP", m), ("PP", q))}
        out |= {f"{p}_{t}_term_{label}": F.when(ready, v * values[k]) for t, v in (("MAP", m), ("PP", q), ("SBP", m + 2 * q / 3), ("DBP", m - q / 3))}
    if method.base:
        scales = dict(models[method.base].get("pp_term_scales") or base.scales)
        values = [F.lit(1.0), *own]
        m, q = total([float(c) for c in models[method.base]["MAP"]], values), total(ridge.scaled(models[method.base]["PP"], base.labels, scales).tolist(), values)
        out |= {f"{p}_SBP_base": F.when(ready, systolic(m, q)), f"{p}_DBP_base": F.when(ready, diastolic(m, q))}
        out |= {f"{p}_SBP_correction": s - F.col(f"{p}_SBP_base"), f"{p}_DBP_correction": d - F.col(f"{p}_DBP_base")}
    return out


def append_columns(df: DataFrame, models: Mapping[str, Mapping], methods: Sequence[Method] = METHODS, preserve: bool = True) -> DataFrame:
    """df with the prediction columns of all methods that models has, as expressions in one projection.
    With preserve, columns of that name that df has stay; otherwise they are replaced."""
    known, source = {m.prefix: m for m in methods}, df
    for m in methods:
        if m.prefix in models and (m.base is None or m.base in models):
            new = predicted(source, m, models[m.prefix], known, models)
            late = {c: x for c, x in new.items() if c.endswith("_correction")}
            for columns in ({c: x for c, x in new.items() if c not in late}, late):
                df = df.withColumns({c: x for c, x in columns.items() if not (preserve and c in source.columns)})
    return df


def stored_predictions(df: DataFrame, methods: Mapping[str, str], series: str = "smoothed", keep: Sequence[str] = ("session_id", "beat_index")) -> DataFrame:
    """The stored columns <prefix>_SBP_<series> and <prefix>_DBP_<series> as a prediction set: keep, method,
    ref_SBP, ref_DBP, pred_SBP, pred_DBP, pred_MAP, pred_PP, where both are there. methods: prefix by name."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("method"), number(F.col(f"{p}_SBP_{series}")).alias("pred_SBP"), number(F.col(f"{p}_DBP_{series}")).alias("pred_DBP")) for name, p in methods.items()]))
    out = df.select(*keep, "ref_SBP", "ref_DBP", rows.alias("__p")).select(*keep, "ref_SBP", "ref_DBP", "__p.*").dropna(subset=["pred_SBP", "pred_DBP"])
    s, d = F.col("pred_SBP"), F.col("pred_DBP")
    return out.withColumns({"pred_MAP": (s + 2 * d) / 3, "pred_PP": s - d})


def prediction_rows(df: DataFrame, session: str, value, columns: Sequence[str]) -> DataFrame:
    """The predictions of one session, by row_index and method."""
    return df.where(F.col(session) == value).select(session, "row_index", "method", *columns).orderBy("row_index", "method")
