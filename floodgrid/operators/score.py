"""Prediction scores: masked pair aggregates over cells (..., pred, target, mask).

Every score is a function of sums. ``score`` merges the sums of any number of named metrics into
one aggregation, so a table is read and shuffled once; sums of patches add up to sums of time
steps, scenarios and data sets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BANDS, EPS, depth_band, finite, ratio, sigmoid_event, wet


def _p() -> Column:
    return finite("pred")


def _t() -> Column:
    return finite("target")


def _m() -> Column:
    """Weight of a cell: its mask, 0 where a value is missing."""
    return F.when(_p().isNotNull() & _t().isNotNull(), F.coalesce(F.col("mask").cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def _in() -> Column:
    return _m() > 0.5


@dataclass(frozen=True)
class Metric:
    """``sums``: aggregates by name; ``final``: the score of those columns; ``better``: higher or lower."""

    sums: dict[str, Column]
    final: Column = field(compare=False)
    better: str = "higher"


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _count(c: Column) -> Column:
    return F.count_if(c)


def _cut(c: Column, threshold: float | None) -> Column:
    return c if threshold is None else F.when(c < threshold, F.lit(0.0)).otherwise(c)


def _error(threshold: float | None, tolerance: float | None) -> Column:
    d = _cut(_p(), threshold) - _cut(_t(), threshold)
    return d if tolerance is None else F.when(F.abs(d) < tolerance, F.lit(0.0)).otherwise(d)


def rmse(name: str, threshold: float | None = None, tolerance: float | None = None, empty: str = "zero") -> Metric:
    """sqrt of the masked mean squared error. ``threshold``: smaller values count as 0 in both;
    ``tolerance``: smaller errors count as 0 (the denominator is the whole mask in either case)."""
    d = _error(threshold, tolerance)
    sums = {f"{name}_sse": _sum(d * d * _m()), f"{name}_n": _sum(_m())}
    return Metric(sums, F.sqrt(ratio(F.col(f"{name}_sse"), F.col(f"{name}_n"), empty)), "lower")


def rmse_conditional(name: str, ge: float | None = None, lt: float | None = None, tolerance: float | None = None) -> Metric:
    """Only cells whose target lies in [ge, lt); NULL if there is none."""
    ok = _in()
    if ge is not None:
        ok &= _t() >= ge
    if lt is not None:
        ok &= _t() < lt
    d = _error(None, tolerance)
    sums = {f"{name}_sse": _sum(F.when(ok, d * d)), f"{name}_n": _count(ok)}
    return Metric(sums, F.sqrt(ratio(F.col(f"{name}_sse"), F.col(f"{name}_n"), "null")), "lower")


def nse(name: str, threshold: float | None = None, tolerance: float | None = None, safe: bool = False, min_var: float = 1e-6, lower: float = -1.0, exact: float = 1e-3) -> Metric:
    """1 - SSE / SST about the masked mean of the target.

    ``safe``: where SST is below ``min_var`` the score is 1 if SSE <= exact^2 * n, else
    max(1 - SSE / min_var, lower). SST is the population variance times n, which doesn't cancel.
    """
    d, t = _error(threshold, tolerance), _cut(_t(), threshold)
    inside = F.when(_in(), t)
    sums = {f"{name}_sse": _sum(F.when(_in(), d * d)), f"{name}_n": F.count(inside), f"{name}_sst": F.coalesce(F.var_pop(inside) * F.count(inside), F.lit(0.0))}
    sse, n, sst = (F.col(f"{name}_{k}") for k in ("sse", "n", "sst"))
    if safe:
        flat = F.when(sse <= exact * exact * n, F.lit(1.0)).otherwise(F.greatest(1 - sse / min_var, F.lit(lower)))
        final = F.when(n == 0, F.lit(None)).when(sst < min_var, flat).otherwise(1 - F.try_divide(sse, sst))
    else:
        final = 1 - sse / (sst + EPS)
    return Metric(sums, final)


def _events(threshold: float, tolerance: float | None) -> tuple[Column, Column]:
    p, t = wet(_p(), threshold), wet(_t(), threshold)
    return (p, t) if tolerance is None else (F.when(F.abs(_p() - _t()) <= tolerance, t).otherwise(p), t)


def _confusion(name: str, p: Column, t: Column, ok: Column | None = None) -> dict[str, Column]:
    ok = _in() if ok is None else ok
    return {
        f"{name}_tp": _count(ok & p & t), f"{name}_fp": _count(ok & p & ~t), f"{name}_fn": _count(ok & ~p & t), f"{name}_n": _count(ok),
    }


def _of(name: str, kind: str, empty: str) -> Column:
    tp, fp, fn, n = (F.col(f"{name}_{k}") for k in ("tp", "fp", "fn", "n"))
    den = {"csi": tp + fp + fn, "precision": tp + fp, "recall": tp + fn, "target_prevalence": n, "pred_prevalence": n}[kind]
    num = {"target_prevalence": tp + fn, "pred_prevalence": tp + fp}.get(kind, tp)
    return ratio(num, den, empty)


def event(name: str, kind: str, threshold: float, tolerance: float | None = None, empty: str = "zero") -> Metric:
    """``kind``: csi, precision, recall, target_prevalence or pred_prevalence of value >= threshold.

    With a tolerance, a prediction that is no further off has the target's event."""
    return Metric(_confusion(name, *_events(threshold, tolerance)), _of(name, kind, empty))


def band(name: str, kind: str, ge: float | None, lt: float | None, empty: str = "zero") -> Metric:
    """precision or recall of the event that a value lies in [ge, lt)."""
    def inside(c: Column) -> Column:
        out = c.isNotNull()
        if ge is not None:
            out &= c >= ge
        if lt is not None:
            out &= c < lt
        return F.coalesce(out, F.lit(False))
    return Metric(_confusion(name, inside(_p()), inside(_t())), _of(name, kind, empty))


def logit_event(name: str, kind: str, channel: str, threshold: float, p: float = 0.5, empty: str = "zero") -> Metric:
    """As ``event``, but the prediction is sigmoid(``channel``) >= p."""
    ok = F.col(channel).isNotNull() & _t().isNotNull() & (F.coalesce(F.col("mask"), F.lit(0)) > 0.5)
    return Metric(_confusion(name, F.coalesce(sigmoid_event(channel, p), F.lit(False)), wet(_t(), threshold), ok), _of(name, kind, empty))


def logit_band(name: str, kind: str, interval: str, thresholds: tuple[float, float, float], channels: tuple[str, str, str] = ("l1", "l2", "l3"), p: float = 0.5, empty: str = "zero") -> Metric:
    """precision, recall or prevalence of one of four ordered bands, predicted by three logits."""
    a, b, c = (F.coalesce(sigmoid_event(x, p), F.lit(False)) for x in channels)
    predicted = dict(zip(BANDS, (~a, a & ~b, b & ~c, c), strict=True))[interval]
    true = F.coalesce(depth_band(_t(), *thresholds) == interval, F.lit(False))
    ok = F.coalesce(F.col("mask"), F.lit(0)) > 0.5
    return Metric(_confusion(name, predicted, true, ok & _t().isNotNull()), _of(name, kind, empty))


#: Metric registry: a config entry names one of these and its options.
REGISTRY = {"rmse": rmse, "rmse_conditional": rmse_conditional, "nse": nse, "event": event, "band": band, "logit_event": logit_event, "logit_band": logit_band}


def score(cells: DataFrame, config: dict[str, dict], by: list[str], keep_sums: bool = False) -> DataFrame:
    """One column per entry of ``config`` ({"type": name in REGISTRY, options...}), in one aggregation.

    ``better`` in an entry is not used here; ``best_worst`` reads it.
    """
    metrics = {k: REGISTRY[v["type"]](k, **{o: x for o, x in v.items() if o not in ("type", "better")}) for k, v in config.items()}
    sums = {n: c for m in metrics.values() for n, c in m.sums.items()}
    aggregates = [c.alias(n) for n, c in sums.items()]
    summed = cells.groupBy(*by).agg(*aggregates) if by else cells.agg(*aggregates)
    return summed.select(*by, *(sums if keep_sums else []), *[m.final.alias(k) for k, m in metrics.items()])


#: Thresholds of the published evaluation: wet depth, tolerance, and the three band limits.
WET, TOLERANCE, LIMITS = 0.05, 0.01, (0.1, 0.5, 1.0)


def patch_global_stats(cells: DataFrame, keys: list[str], wet_depth: float = WET, tolerance: float = TOLERANCE, limits: tuple = LIMITS, lower: float | None = None) -> DataFrame:
    """The additive vector of each patch; patches with an empty mask are left out."""
    ok, p, t = _in(), _p(), _t()
    d, d_cut, d_tol = p - t, _error(wet_depth, None), _error(wet_depth, tolerance)
    plain, soft = _events(wet_depth, None), _events(wet_depth, tolerance)
    sums = {
        "n": _count(ok), "sse": _sum(F.when(ok, d * d)), "sse_cut": _sum(F.when(ok, d_cut * d_cut)), "sse_tol": _sum(F.when(ok, d_tol * d_tol)),
        "sum_t": _sum(F.when(ok, t)), "sum_t2": _sum(F.when(ok, t * t)),
        "tp": _count(ok & plain[0] & plain[1]), "fp": _count(ok & plain[0] & ~plain[1]), "fn": _count(ok & ~plain[0] & plain[1]),
        "tp_tol": _count(ok & soft[0] & soft[1]), "fp_tol": _count(ok & soft[0] & ~soft[1]), "fn_tol": _count(ok & ~soft[0] & soft[1]),
        "pred_wet": _count(ok & plain[0]), "target_wet": _count(ok & plain[1]),
    }
    pb, tb = depth_band(p, *limits, lower=lower), depth_band(t, *limits, lower=lower)
    for b in BANDS:
        ip, it = F.coalesce(pb == b, F.lit(False)), F.coalesce(tb == b, F.lit(False))
        sums |= {
            f"{b}_n": _count(ok & it), f"{b}_sse": _sum(F.when(ok & it, d * d)),
            f"{b}_tp": _count(ok & ip & it), f"{b}_fp": _count(ok & ip & ~it), f"{b}_fn": _count(ok & ~ip & it),
        }
    return cells.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()]).where("n > 0")


def metrics_of_sums(summed: DataFrame, keys: list[str], empty: str = "zero") -> DataFrame:
    """RMSE, NSE, CSI, precision and recall, plain, tolerant and by band, of summed vectors."""
    c = F.col
    sst = F.greatest(c("sum_t2") - c("sum_t") * c("sum_t") / (c("n") + EPS), F.lit(0.0))
    out = {
        "rmse": F.sqrt(ratio(c("sse"), c("n"), empty)), "rmse_cut": F.sqrt(ratio(c("sse_cut"), c("n"), empty)), "rmse_tol": F.sqrt(ratio(c("sse_tol"), c("n"), empty)),
        "nse": 1 - c("sse") / (sst + EPS),
    }
    for end in ("", "_tol"):
        tp, fp, fn = c(f"tp{end}"), c(f"fp{end}"), c(f"fn{end}")
        out |= {f"csi{end}": ratio(tp, tp + fp + fn, empty), f"precision{end}": ratio(tp, tp + fp, empty), f"recall{end}": ratio(tp, tp + fn, empty)}
    out |= {"pred_prevalence": ratio(c("pred_wet"), c("n"), empty), "target_prevalence": ratio(c("target_wet"), c("n"), empty)}
    for b in BANDS:
        tp, fp, fn = c(f"{b}_tp"), c(f"{b}_fp"), c(f"{b}_fn")
        out |= {f"{b}_rmse": F.sqrt(ratio(c(f"{b}_sse"), c(f"{b}_n"), empty)), f"{b}_precision": ratio(tp, tp + fp, empty), f"{b}_recall": ratio(tp, tp + fn, empty)}
    return summed.select(*keys, "n", *[v.alias(k) for k, v in out.items()])


#: Levels of aggregation and their keys.
LEVELS = {"patch": ["scenario", "t", "patch_row", "patch_col"], "time": ["scenario", "t"], "scenario": ["scenario"], "dataset": []}


def global_metrics(stats: DataFrame, levels: tuple[str, ...] = ("time", "scenario", "dataset"), empty: str = "zero") -> DataFrame:
    """Metrics of the summed vectors at each level, by one grouping-sets pass over the patch rows."""
    keys = LEVELS["patch"]
    used = [k for k in keys if any(k in LEVELS[x] for x in levels)]
    numbers = [c for c in stats.columns if c not in (*keys, "var")]
    sets = [[F.col(k) for k in LEVELS[x]] for x in levels]
    summed = stats.groupingSets(sets, *[F.col(k) for k in used]).agg(F.grouping_id().alias("_id"), *[F.sum(c).alias(c) for c in numbers])
    ids = {x: sum(1 << (len(used) - 1 - i) for i, k in enumerate(used) if k not in LEVELS[x]) for x in levels}
    name = F.coalesce(*[F.when(F.col("_id") == i, F.lit(x)) for x, i in ids.items()])
    return metrics_of_sums(summed.withColumn("level", name), ["level", *used], empty)


def patch_mean_metrics(scores: DataFrame, metrics: list[str], by: list[str], weight: str = "n") -> DataFrame:
    """Unweighted and ``weight``-weighted mean of the finite patch scores."""
    out = []
    for m in metrics:
        v, w = finite(m), F.when(F.col(weight) > 0, F.col(weight).cast("double"))
        out += [F.avg(v).alias(m), F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))).alias(f"{m}_weighted")]
    return scores.groupBy(*by).agg(F.count("*").alias("n_patches"), *out)


def confusion_full(cells: DataFrame, by: list[str], threshold: float = WET, empty: str = "zero") -> DataFrame:
    """TP, FP, FN, TN and all shares of them, those of the dry class too."""
    p, t = _events(threshold, None)
    sums = _confusion("e", p, t)
    out = cells.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    tp, fp, fn, n = (F.col(f"e_{k}") for k in ("tp", "fp", "fn", "n"))
    tn = n - tp - fp - fn
    return out.select(
        *by, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        ratio(tp, tp + fp + fn, empty).alias("csi"), ratio(tp, tp + fp, empty).alias("precision"), ratio(tp, tp + fn, empty).alias("recall"),
        ratio(tn, tn + fn, empty).alias("dry_precision"), ratio(tn, tn + fp, empty).alias("dry_recall"),
        ratio(tp + fp, n, empty).alias("pred_prevalence"), ratio(tp + fn, n, empty).alias("target_prevalence"),
    )


# Losses, as evaluation aggregates ---------------------------------------------------------------


def _per_patch(cells: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    rows = cells.groupBy(*keys).agg(_sum(value * weight).alias("_v"), _sum(weight).alias("_w"))
    return rows.where("_w > 0").select(*keys, (F.col("_v") / F.col("_w")).alias("loss"))


def masked_l1(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Masked mean absolute error of each patch with a mask; average ``loss`` for the total."""
    return _per_patch(cells, keys, F.abs(_p() - _t()), _m())


def masked_l2(cells: DataFrame, keys: list[str]) -> DataFrame:
    return _per_patch(cells, keys, F.pow(_p() - _t(), 2), _m())


def charbonnier(cells: DataFrame, by: list[str], eps: float = 1e-12) -> DataFrame:
    """Mean of sqrt(d^2 + eps) over all cells."""
    d = _p() - _t()
    return cells.groupBy(*by).agg(F.avg(F.sqrt(d * d + eps)).alias("loss"))


def weighted_loss(
    cells: DataFrame, keys: list[str], tau: float, wet_weight: float = 2.0, excess_weight: float = 1.0, mode: str = "exp", power: int = 1,
    scale: float = 1.0, gamma: float = 1.0, least: float = 0.0, most: float = 20.0, minmax: bool = False,
) -> DataFrame:
    """Masked mean of w * |d|^power of each patch with a mask; w = 1 + wet_weight * wet + excess_weight * g, within [least, most].

    g is a function of the target's excess over ``tau`` (a share of 1 - tau where values are scaled
    to ``minmax``). ``mode``: none, linear, power ((excess / scale)^gamma), or exp, which saturates:
    1 - exp(-excess / scale).
    """
    excess = F.greatest(_t() - tau, F.lit(0.0))
    excess = excess / max(1 - tau, EPS) if minmax else excess
    part = excess / max(scale, EPS)
    g = {"none": F.lit(0.0), "linear": excess, "power": F.pow(part, F.lit(gamma)), "exp": 1 - F.exp(-part)}[mode]
    w = F.greatest(F.least(1 + wet_weight * wet(_t(), tau).cast("double") + excess_weight * g, F.lit(most)), F.lit(least))
    d = F.abs(_p() - _t())
    return _per_patch(cells, keys, w * (d if power == 1 else d * d), _m())


def _selected(cells: DataFrame, keys: list[str], value: Column, chosen: Column) -> DataFrame:
    """Masked sum of ``value`` over the masked number of ``chosen`` cells, of each patch that has some."""
    rows = cells.groupBy(*keys).agg(_sum(value * _m()).alias("_v"), _sum(F.when(chosen, _m())).alias("_w"))
    return rows.where("_w > 0").select(*keys, (F.col("_v") / F.col("_w")).alias("loss"))


def band_loss(
    cells: DataFrame, keys: list[str], tau: float, delta: float, kernel: str = "hard", sigma_ratio: float = 0.5, truncate: bool = True, edges: tuple[float, float] | None = None
) -> DataFrame:
    """|d| near the threshold, of each patch with cells in the band; average ``loss`` for the total.

    The band is [max(0, tau - delta), tau + delta], or ``edges`` where values are not physical ones.
    Cells weigh 1 (hard) or by a Gaussian around tau whose sigma is ``sigma_ratio`` of half the band;
    without ``truncate`` cells outside weigh too. The sum is over the number of cells in the band.
    """
    low, high = edges or (max(0.0, tau - delta), tau + delta)
    inside = (_t() >= low) & (_t() <= high)
    if kernel == "hard":
        w = F.when(inside, F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        z = (_t() - tau) / (max(sigma_ratio, EPS) * max(abs(high - low) / 2, EPS) + EPS)
        w = F.exp(-0.5 * z * z)
        w = F.when(inside, w).otherwise(F.lit(0.0)) if truncate else w
    return _selected(cells, keys, F.abs(_p() - _t()) * w, inside)


def range_loss(cells: DataFrame, keys: list[str], low: float | None, high: float | None, kind: str = "l1", beta: float = 1.0, low_in: bool = True, high_in: bool = False) -> DataFrame:
    """Mean loss over cells whose target lies in a range, of each patch that has such cells; average ``loss`` for the total."""
    ok = F.lit(True)
    if low is not None:
        ok &= _t() >= low if low_in else _t() > low
    if high is not None:
        ok &= _t() <= high if high_in else _t() < high
    d = F.abs(_p() - _t())
    value = {"l1": d, "l2": d * d, "smooth_l1": F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)}[kind]
    return _selected(cells, keys, F.when(ok, value).otherwise(F.lit(0.0)), ok)


def _bce(logit: Column, event: Column, pos_weight: float, focal: float, alpha: float) -> Column:
    """Stable binary cross-entropy of a logit; a focal one weighs events by alpha and others by 1 - alpha."""
    y = event.cast("double")
    soft = F.log1p(F.exp(-F.abs(logit)))
    loss = pos_weight * y * (F.greatest(-logit, F.lit(0.0)) + soft) + (1 - y) * (F.greatest(logit, F.lit(0.0)) + soft)
    if focal > 0:
        p = 1 / (1 + F.exp(-logit))
        loss = loss * F.pow(1 - (y * p + (1 - y) * (1 - p)), F.lit(focal)) * (alpha * y + (1 - alpha) * (1 - y))
    return loss


def _logit_mask() -> Column:
    return F.when(_t().isNotNull(), F.coalesce(F.col("mask").cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def bce_loss(cells: DataFrame, keys: list[str], channel: str, threshold: float, pos_weight: float = 1.0, focal: float = 0.0, alpha: float = 0.75) -> DataFrame:
    """Cross-entropy of a logit with target >= threshold, of each patch with a mask; average ``loss`` for the total."""
    return _per_patch(cells, keys, _bce(F.col(channel), wet(_t(), threshold), pos_weight, focal, alpha), _logit_mask())


def ordinal_bce_loss(
    cells: DataFrame, keys: list[str], thresholds: tuple[float, ...], channels: tuple[str, ...] = ("l1", "l2", "l3"), weights: tuple[float, ...] | None = None,
    pos_weights: tuple[float, ...] | None = None, focal: float = 0.0, alpha: float = 0.75,
) -> DataFrame:
    """Weighted sum of the ordered thresholds' cross-entropies, of each patch with a mask; average ``loss`` for the total."""
    ones = (1.0,) * len(channels)
    parts = zip(channels, thresholds, weights or ones, pos_weights or ones, strict=True)
    value = sum((w * _bce(F.col(c), wet(_t(), x), pos, focal, alpha) for c, x, w, pos in parts), F.lit(0.0))
    return _per_patch(cells, keys, value, _logit_mask())


def prevalence_loss(cells: DataFrame, keys: list[str], channel: str, threshold: float) -> DataFrame:
    """Square of the mean probability less the share of events, of each patch with a mask; average ``loss`` for the total."""
    gap = 1 / (1 + F.exp(-F.col(channel))) - wet(_t(), threshold).cast("double")
    return _per_patch(cells, keys, gap, _logit_mask()).withColumn("loss", F.col("loss") * F.col("loss"))


def psnr(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", most: float = 255.0) -> DataFrame:
    """10 log10(most^2 / MSE); equal images have NULL and ``equal`` true (their PSNR is infinite)."""
    mse = F.avg(F.pow(F.col(a).cast("double") - F.col(b), 2))
    rows = pairs.groupBy(*by).agg(mse.alias("mse"))
    return rows.select(*by, "mse", (F.col("mse") == 0).alias("equal"), F.when(F.col("mse") > 0, 10 * F.log10(F.lit(most * most) / F.col("mse"))).alias("psnr"))
