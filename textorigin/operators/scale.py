"""Response of a document's probability features to model scale (prefix ``scale_``). All in-row arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..functions.columns import finite, shifted_ratio, to_number
from ..functions.fixed_values import SCALE_METRICS, SMALL

SCALES = ("ng1", "ng2", "ng3", "ng4")


def metric_column(columns: Sequence[str], prefixes: Sequence[str], metric: str) -> str | None:
    """``prefix_metric`` for the first prefix that has it, else any column with that start and end."""
    for p in prefixes:
        if f"{p}_{metric}" in columns:
            return f"{p}_{metric}"
    return next((c for c in columns if c.endswith(f"_{metric}") and c.startswith(tuple(prefixes))), None)


def scale_table(tables: dict[str, DataFrame], prefixes: dict[str, Sequence[str]] | None = None, key: str = "id",
                metrics: Sequence[str] = SCALE_METRICS) -> tuple[DataFrame, list[str], list[str]]:
    """Feature tables of several scales joined on id with columns ``{scale}__{metric}``; (table, scales, metrics)."""
    merged, seen = None, set()
    for scale, df in tables.items():
        picked = [key]
        for metric in metrics:
            c = metric_column(df.columns, (prefixes or {}).get(scale, [scale]), metric)
            if c is not None:
                picked.append(to_number(F.col(c)).alias(f"{scale}__{metric}"))
                seen.add(metric)
        one = df.select(*picked)
        merged = one if merged is None else merged.join(one, key, "full_outer")
    return merged, list(tables), [m for m in metrics if m in seen]


def scale_columns(table: DataFrame, scales: Sequence[str] = SCALES, prefixes: dict[str, Sequence[str]] | None = None, key: str = "id",
                  metrics: Sequence[str] = SCALE_METRICS) -> tuple[DataFrame, list[str], list[str]]:
    """As :func:`scale_table` where all scales already stand in one table: columns are renamed, nothing is joined."""
    picked, seen = [F.col(key)], set()
    for scale in scales:
        for metric in metrics:
            c = metric_column(table.columns, (prefixes or {}).get(scale, [scale]), metric)
            if c is not None:
                picked.append(to_number(F.col(c)).alias(f"{scale}__{metric}"))
                seen.add(metric)
    return table.select(*picked), list(scales), [m for m in metrics if m in seen]


def line_fit(pts: Column) -> Column:
    """Struct slope, intercept, r2; null below two points, r2 null where y hardly varies."""
    def fit(p, mx, my):
        sxx = F.aggregate(p, F.lit(0.0), lambda a, q: a + (q["x"] - mx) * (q["x"] - mx))
        sxy = F.aggregate(p, F.lit(0.0), lambda a, q: a + (q["x"] - mx) * (q["y"] - my))
        slope = F.try_divide(sxy, sxx)

        def with_slope(b):
            c = my - b * mx
            res = F.aggregate(p, F.lit(0.0), lambda a, q: a + (q["y"] - (b * q["x"] + c)) * (q["y"] - (b * q["x"] + c)))
            tot = F.aggregate(p, F.lit(0.0), lambda a, q: a + (q["y"] - my) * (q["y"] - my))
            r2 = F.when(tot > SMALL, 1.0 - res / (tot + SMALL))
            return F.struct(b.alias("slope"), c.alias("intercept"), r2.alias("r2"))

        return A.let(slope, with_slope)

    body = lambda p: A.let(A.mean(F.transform(p, lambda q: q["x"])), lambda mx: A.let(A.mean(F.transform(p, lambda q: q["y"])), lambda my: fit(p, mx, my)))
    return F.when(F.size(pts) >= 2, A.let(pts, body))


def _steps(p: Column) -> Column:
    """Neighbouring pairs (previous point, point)."""
    return F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda q, i: F.struct(F.get(p, i).alias("a"), q.alias("b")))


def area(p: Column) -> Column:
    return F.when(F.size(p) >= 2, F.aggregate(_steps(p), F.lit(0.0), lambda s, t: s + (t["b"]["y"] + t["a"]["y"]) * (t["b"]["x"] - t["a"]["x"]) * 0.5))


def gradient(p: Column) -> Column:
    """Derivative at each point: second order inside on an uneven grid, one-sided at the ends."""
    def at(q, i):
        prev, nxt = F.get(p, i - 1), F.get(p, i + 1)
        hs, hd = q["x"] - prev["x"], nxt["x"] - q["x"]
        inner = (hs * hs * nxt["y"] + (hd * hd - hs * hs) * q["y"] - hd * hd * prev["y"]) / (hs * hd * (hd + hs))
        d = (
            F.when(i == 0, (nxt["y"] - q["y"]) / hd)
            .when(i == F.size(p) - 1, (q["y"] - prev["y"]) / hs)
            .otherwise(inner)
        )
        return F.struct(q["x"].alias("x"), d.alias("y"))

    return F.transform(p, at)


def curvature(p: Column) -> Column:
    return F.when(F.size(p) >= 3, A.let(gradient(p), lambda g: A.mean(F.transform(gradient(g), lambda q: q["y"]))))


def _response(m: Column, n_scales: int) -> Column:
    """All outputs of one metric as a struct; ``m`` is a struct of its values y0, y1, ... by scale."""
    ys = [m[f"y{i}"] for i in range(n_scales)]
    known = F.filter(
        F.array(*[F.struct(F.lit(float(i)).alias("x"), y.alias("y")) for i, y in enumerate(ys)]), lambda p: p["y"].isNotNull())

    def outputs(p, fit, deltas, moving):
        n = F.size(p)
        values = F.transform(p, lambda q: q["y"])
        span = F.try_element_at(p, F.lit(-1))["x"] - F.get(p, F.lit(0))["x"]
        turns = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(moving) - 1, F.lit(1))), F.lit(0.0),
            lambda acc, i: acc + F.when(F.get(moving, i) != F.get(moving, i - 1), 1.0).otherwise(0.0))
        first_at = lambda extreme: F.get(F.transform(F.filter(p, lambda q: q["y"] == extreme), lambda q: q["x"]), F.lit(0))
        share = lambda test: F.when(n >= 2, A.mean(F.transform(deltas, lambda d: F.when(test(d), 1.0).otherwise(0.0))))
        out = {
            "global_slope": fit["slope"],
            "global_intercept": fit["intercept"],
            "global_r2": fit["r2"],
            "response_area": area(p),
            "normalized_area": F.when((n >= 2) & (span > SMALL), area(p) / (span + SMALL)),
            "response_curvature": curvature(p),
            "response_variance": F.when(n > 0, A.let(A.mean_std(values)["std"], lambda s: s * s)),
            "response_range": F.when(n > 0, F.array_max(values) - F.array_min(values)),
            "min_scale_index": first_at(F.array_min(values)),
            "max_scale_index": first_at(F.array_max(values)),
            "monotonic_decrease_ratio": share(lambda d: d < 0),
            "monotonic_increase_ratio": share(lambda d: d > 0),
            "num_direction_changes": F.when((n >= 2) & (F.size(moving) >= 1), F.when(F.size(moving) == 1, 0.0).otherwise(turns)),
        }
        for i, (a, b) in enumerate(zip(ys, ys[1:])):
            out[f"slope_{i}"] = (b - a) / F.lit(1.0 + SMALL)
            out[f"ratio_{i}"] = shifted_ratio(b, a)
            out[f"abs_delta_{i}"] = F.abs(b - a)
            out[f"rel_delta_{i}"] = shifted_ratio(b - a, F.abs(a))
        if n_scales == 4:
            early, late = ys[0] - ys[1], ys[2] - ys[3]
            out |= {"early_gain": early, "late_gain": late, "saturation": F.abs(late), "saturation_ratio": shifted_ratio(F.abs(late), F.abs(early))}
        # bound first: the finiteness test names its operand several times
        return A.let(F.struct(*[v.alias(k) for k, v in out.items()]), lambda s: F.struct(*[finite(s[k]).alias(k) for k in out]))

    with_deltas = lambda p, fit: A.let(
        F.transform(_steps(p), lambda t: t["b"]["y"] - t["a"]["y"]),
        lambda d: A.let(F.transform(F.filter(d, lambda x: F.abs(x) > SMALL), F.signum), lambda s: outputs(p, fit, d, s)))
    return A.let(known, lambda p: A.let(line_fit(p), lambda fit: with_deltas(p, fit)))


def scale_response(merged: DataFrame, scales: Sequence[str] = SCALES, metrics: Sequence[str] = SCALE_METRICS, key: str = "id") -> DataFrame:
    """All scale-response columns of a joined scale table.

    The formulas are stated once and mapped over an array of the metrics, which keeps the plan small.
    """
    has = lambda s, m: f"{s}__{m}" in merged.columns
    value = lambda s, m: finite(F.col(f"{s}__{m}")) if has(s, m) else F.lit(None).cast("double")
    gaps = [s for s in scales if has(s, "top_10_percent_loss_mean") and has(s, "bottom_10_percent_loss_mean")]
    gap = lambda s: value(s, "top_10_percent_loss_mean") - value(s, "bottom_10_percent_loss_mean") if s in gaps else F.lit(None).cast("double")
    rows = [F.struct(*[value(s, m).alias(f"y{i}") for i, s in enumerate(scales)]) for m in metrics]
    rows.append(F.struct(*[gap(s).alias(f"y{i}") for i, s in enumerate(scales)]))
    staged = merged.select(key, F.array(*rows).alias("_m")).withColumn("_r", F.transform("_m", lambda m: _response(m, len(scales))))
    at = {m: f"_r[{i}]" for i, m in enumerate([*metrics, "gap"])}
    names = {f"{k}_{i}": f"{k}_{a}_to_{b}" for i, (a, b) in enumerate(zip(scales, scales[1:])) for k in ("slope", "ratio", "abs_delta", "rel_delta")}
    if len(scales) == 4:
        a, b, c, d = scales
        names |= {"early_gain": f"early_gain_{a}_{b}", **{k: f"{k}_{c}_{d}" for k in ("late_gain", "saturation", "saturation_ratio")}}
    fields = staged.schema["_r"].dataType.elementType.fieldNames()
    pair_known = lambda f, m: not (f.rsplit("_", 1)[-1].isdigit() and not all(has(s, m) for s in scales[int(f[-1]) : int(f[-1]) + 2]))
    out = {f"scale_{m}_{names.get(f, f)}": f"{at[m]}.{f}" for m in metrics for f in fields if pair_known(f, m)}
    if "loss_mean" in metrics:
        for m in ("ppl", "loss_std"):
            if m in metrics:
                out[f"scale_{m}_loss_mean_global_slope_ratio"] = f"try_divide({at[m]}.global_slope, {at['loss_mean']}.global_slope + {SMALL!r}D)"
    for s in gaps:
        out[f"scale_top_bottom_loss_gap_{s}"] = f"_m[{len(metrics)}].y{scales.index(s)}"
    if gaps:
        out["scale_top_bottom_loss_gap_global_slope"] = f"{at['gap']}.global_slope" if len(gaps) > 1 else "cast(null as double)"
    return staged.selectExpr(key, *[f"{v} as {k}" for k, v in out.items()])


def manifest(features: DataFrame, scales: Sequence[str], metrics: Sequence[str], key: str = "id") -> dict:
    names = [c for c in features.columns if c != key]
    return {"available_scales": list(scales), "metrics_used": list(metrics), "feature_count": len(names), "feature_names": names}
