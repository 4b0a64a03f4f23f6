"""Queries of the score operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import BANDS
from ..operators import patchwise, sampling
from ..operators import score as S
from ..operators.resample import block_mean
from ..operators.cells import patches_to_cells
from ..operators.maps import resize_patches, tv_of_patches
from ..sources.adapters import CELLS_SQL, WIDE_SQL, cells, vectors, wide_cells
from .registry import SQL, query, rounded

KEYS = ["scenario", "t", "patch_row", "patch_col"]
_D = "(pred - target)"
_EPS = "1e-12::DOUBLE"


def _ratio(num: str, den: str) -> str:
    return f"coalesce({num}, 0)::DOUBLE / (coalesce({den}, 0) + {_EPS})"


def _n(cond: str) -> str:
    return f"count(*) FILTER (WHERE mask = 1 AND {cond})"


def _by(names: list[str], items: dict[str, str], source: str = CELLS_SQL, frm: str = "cells", tail: str = "") -> str:
    cols = ", ".join([*names, *(f"round({v}, 6) AS {k}" for k, v in items.items())])
    group = f" GROUP BY {', '.join(names)}" if names else ""
    return f"{source} SELECT {cols} FROM {frm}{group} {tail}"


_CUT = "(CASE WHEN pred < 0.05::DOUBLE THEN 0 ELSE pred END - CASE WHEN target < 0.05::DOUBLE THEN 0 ELSE target END)"
_TOL = f"(CASE WHEN abs{_CUT} < 0.01::DOUBLE THEN 0 ELSE {_CUT} END)"
_SSE = lambda d: f"sum(CASE WHEN mask = 1 THEN {d} * {d} ELSE 0 END)"
_N = "sum(mask)"
_PW, _TW = "pred >= 0.1::DOUBLE", "target >= 0.1::DOUBLE"
_SST = "var_pop(target) FILTER (WHERE mask = 1) * sum(mask)"


@query(_by(["scenario"], {"rmse": f"sqrt({_ratio(_SSE(_D), _N)})", "rmse_cut": f"sqrt({_ratio(_SSE(_CUT), _N)})", "rmse_tol": f"sqrt({_ratio(_SSE(_TOL), _N)})"}))
def p1_p3_rmse(spark: SparkSession, sf: str) -> DataFrame:
    config = {"rmse": {"type": "rmse"}, "rmse_cut": {"type": "rmse", "threshold": 0.05}, "rmse_tol": {"type": "rmse", "threshold": 0.05, "tolerance": 0.01}}
    return rounded(S.score(cells(spark, sf), config, ["scenario"]))


@query(_by(["scenario"], {
    "low": f"sqrt(avg({_D} * {_D}) FILTER (WHERE mask = 1 AND target >= 0.1::DOUBLE AND target < 0.5::DOUBLE))",
    "high": f"sqrt(avg(CASE WHEN abs({_D}) < 0.05::DOUBLE THEN 0 ELSE {_D} * {_D} END) FILTER (WHERE mask = 1 AND target >= 1))",
}))
def p4_rmse_conditional(spark: SparkSession, sf: str) -> DataFrame:
    config = {"low": {"type": "rmse_conditional", "ge": 0.1, "lt": 0.5}, "high": {"type": "rmse_conditional", "ge": 1.0, "tolerance": 0.05}}
    return rounded(S.score(cells(spark, sf), config, ["scenario"]))


@query(_by(["scenario"], {"nse": f"1 - {_SSE(_D)} / ({_SST} + {_EPS})", "nse_safe": f"1 - {_SSE(_D)} / ({_SST})"}))
def p5_p6_nse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.score(cells(spark, sf), {"nse": {"type": "nse"}, "nse_safe": {"type": "nse", "safe": True}}, ["scenario"]))


_TP, _FP, _FN = _n(f"{_PW} AND {_TW}"), _n(f"{_PW} AND NOT {_TW}"), _n(f"NOT {_PW} AND {_TW}")


@query(_by(["scenario", "t"], {
    "csi": _ratio(_TP, f"{_TP} + {_FP} + {_FN}"), "precision": _ratio(_TP, f"{_TP} + {_FP}"), "recall": _ratio(_TP, f"{_TP} + {_FN}"),
    "target_share": _ratio(f"{_TP} + {_FN}", _N), "pred_share": _ratio(f"{_TP} + {_FP}", _N),
}))
def p7_p10_events(spark: SparkSession, sf: str) -> DataFrame:
    names = {"csi": "csi", "precision": "precision", "recall": "recall", "target_share": "target_prevalence", "pred_share": "pred_prevalence"}
    return rounded(S.score(cells(spark, sf), {k: {"type": "event", "kind": v, "threshold": 0.1} for k, v in names.items()}, ["scenario", "t"]))


_SOFT = f"CASE WHEN abs({_D}) <= 0.02::DOUBLE THEN {_TW} ELSE {_PW} END"
_STP, _SFP, _SFN = _n(f"({_SOFT}) AND {_TW}"), _n(f"({_SOFT}) AND NOT {_TW}"), _n(f"NOT ({_SOFT}) AND {_TW}")


@query(_by(["scenario"], {"csi": _ratio(_STP, f"{_STP} + {_SFP} + {_SFN}"), "precision": _ratio(_STP, f"{_STP} + {_SFP}"), "recall": _ratio(_STP, f"{_STP} + {_SFN}")}))
def p8_tolerant_events(spark: SparkSession, sf: str) -> DataFrame:
    config = {k: {"type": "event", "kind": k, "threshold": 0.1, "tolerance": 0.02} for k in ("csi", "precision", "recall")}
    return rounded(S.score(cells(spark, sf), config, ["scenario"]))


_BP, _BT = "pred >= 0.1::DOUBLE AND pred < 0.5::DOUBLE", "target >= 0.1::DOUBLE AND target < 0.5::DOUBLE"


@query(_by(["scenario"], {"precision": _ratio(_n(f"{_BP} AND {_BT}"), _n(_BP)), "recall": _ratio(_n(f"{_BP} AND {_BT}"), _n(_BT))}))
def p9_bands(spark: SparkSession, sf: str) -> DataFrame:
    config = {k: {"type": "band", "kind": k, "ge": 0.1, "lt": 0.5} for k in ("precision", "recall")}
    return rounded(S.score(cells(spark, sf), config, ["scenario"]))


_L = "1 / (1 + exp(-l1)) >= 0.6::DOUBLE"


@query(_by(["scenario"], {"csi": _ratio(_n(f"{_L} AND {_TW}"), f"{_n(_L)} + {_n(f'NOT ({_L}) AND {_TW}')}"), "recall": _ratio(_n(f"{_L} AND {_TW}"), _n(_TW))}))
def p11_logit_scores(spark: SparkSession, sf: str) -> DataFrame:
    config = {k: {"type": "logit_event", "kind": k, "channel": "l1", "threshold": 0.1, "p": 0.6} for k in ("csi", "recall")}
    return rounded(S.score(cells(spark, sf), config, ["scenario"]))


def _sig(i: int) -> str:
    return f"(1 / (1 + exp(-l{i})) >= 0.5::DOUBLE)"


@query(_by(["scenario"], {
    "precision": _ratio(_n(f"{_sig(1)} AND NOT {_sig(2)} AND {_BT}"), _n(f"{_sig(1)} AND NOT {_sig(2)}")),
    "recall": _ratio(_n(f"{_sig(1)} AND NOT {_sig(2)} AND {_BT}"), _n(_BT)),
}))
def p12_logit_band_scores(spark: SparkSession, sf: str) -> DataFrame:
    config = {k: {"type": "logit_band", "kind": k, "interval": "slight", "thresholds": (0.1, 0.5, 1.0)} for k in ("precision", "recall")}
    return rounded(S.score(cells(spark, sf), config, ["scenario"]))


_W = {"pw": "pred >= 0.05::DOUBLE", "tw": "target >= 0.05::DOUBLE"}
_EDGES = {"nonflood": "{c} < 0.1::DOUBLE", "slight": "{c} >= 0.1::DOUBLE AND {c} < 0.5::DOUBLE", "severe": "{c} >= 0.5::DOUBLE AND {c} < 1", "extreme": "{c} >= 1"}


def _vector() -> dict[str, str]:
    """The additive sums of the metrics, in SQL."""
    soft = f"CASE WHEN abs({_D}) <= 0.01::DOUBLE THEN {_W['tw']} ELSE {_W['pw']} END"
    out = {"n": _N, "sse": _SSE(_D), "sse_cut": _SSE(_CUT), "sse_tol": _SSE(_TOL), "sum_t": "sum(target) FILTER (WHERE mask = 1)", "sum_t2": "sum(target * target) FILTER (WHERE mask = 1)"}
    for end, p in (("", _W["pw"]), ("_tol", soft)):
        out |= {f"tp{end}": _n(f"({p}) AND {_W['tw']}"), f"fp{end}": _n(f"({p}) AND NOT {_W['tw']}"), f"fn{end}": _n(f"NOT ({p}) AND {_W['tw']}")}
    out |= {"pred_wet": _n(_W["pw"]), "target_wet": _n(_W["tw"])}
    for b, e in _EDGES.items():
        p, t = f"({e.format(c='pred')})", f"({e.format(c='target')})"
        out |= {f"{b}_n": _n(t), f"{b}_sse": f"coalesce(sum({_D} * {_D}) FILTER (WHERE mask = 1 AND {t}), 0)", f"{b}_tp": _n(f"{p} AND {t}"), f"{b}_fp": _n(f"{p} AND NOT {t}"), f"{b}_fn": _n(f"NOT {p} AND {t}")}
    return out


_INTS = {k for k in _vector() if not k.startswith(("s", "sum")) and not k.endswith("sse")} | {f"{b}{e}" for b in BANDS for e in ("_n", "_tp", "_fp", "_fn")}


def _vector_sql(names: list[str], source: str) -> str:
    cols = ", ".join([*names, *(f"CAST({v} AS BIGINT) AS {k}" if k in _INTS else f"round({v}, 6) AS {k}" for k, v in _vector().items())])
    return f"{source} SELECT {cols} FROM cells GROUP BY {', '.join(names)} HAVING sum(mask) > 0"


@query(_vector_sql(KEYS, CELLS_SQL))
def p13_patch_global_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.patch_global_stats(cells(spark, sf), KEYS))


@query(_vector_sql(KEYS, WIDE_SQL))
def p13_patch_global_stats_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.patch_global_stats(wide_cells(spark, sf), KEYS))


def _metrics_sql(levels: list[str], source: str, names: tuple[str, ...] = ("scenario", "t")) -> str:
    sums = ", ".join(f"{v} AS {k}" for k, v in _vector().items())
    m = {"rmse": f"sqrt({_ratio('sse', 'n')})", "rmse_cut": f"sqrt({_ratio('sse_cut', 'n')})", "rmse_tol": f"sqrt({_ratio('sse_tol', 'n')})", "nse": f"1 - sse / (greatest(sum_t2 - sum_t * sum_t / (n + {_EPS}), 0) + {_EPS})"}
    for end in ("", "_tol"):
        tp, fp, fn = f"tp{end}", f"fp{end}", f"fn{end}"
        m |= {f"csi{end}": _ratio(tp, f"{tp} + {fp} + {fn}"), f"precision{end}": _ratio(tp, f"{tp} + {fp}"), f"recall{end}": _ratio(tp, f"{tp} + {fn}")}
    m |= {"pred_prevalence": _ratio("pred_wet", "n"), "target_prevalence": _ratio("target_wet", "n")}
    for b in BANDS:
        m |= {f"{b}_rmse": f"sqrt({_ratio(f'{b}_sse', f'{b}_n')})", f"{b}_precision": _ratio(f"{b}_tp", f"{b}_tp + {b}_fp"), f"{b}_recall": _ratio(f"{b}_tp", f"{b}_tp + {b}_fn")}
    cols = ", ".join(f"round({v}, 6) AS {k}" for k, v in m.items())
    sets = {"time": "(scenario, t)", "scenario": "(scenario)", "dataset": "()"}
    level = "CASE WHEN grouping(scenario) = 1 THEN 'dataset' " + ("WHEN grouping(t) = 1 THEN 'scenario' ELSE 'time' END" if "t" in names else "ELSE 'scenario' END")
    keys = ", ".join(names)
    return f"{source}, s AS (SELECT {level} AS level, {keys}, {sums} FROM cells GROUP BY GROUPING SETS ({', '.join(sets[x] for x in levels)})) SELECT level, {keys}, CAST(n AS BIGINT) AS n, {cols} FROM s"


@query(_metrics_sql(["time", "scenario", "dataset"], CELLS_SQL))
def p14_global_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.global_metrics(S.patch_global_stats(cells(spark, sf), KEYS)))


@query(_metrics_sql(["scenario", "dataset"], WIDE_SQL, ("scenario",)))
def p14_global_metrics_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.global_metrics(S.patch_global_stats(wide_cells(spark, sf), KEYS), ("scenario", "dataset")))


_PATCH_RMSE = f"p AS (SELECT {', '.join(KEYS)}, sum(mask) AS n, sqrt({_ratio(_SSE(_D), _N)}) AS rmse FROM cells GROUP BY {', '.join(KEYS)} HAVING sum(mask) > 0)"


@query(f"{CELLS_SQL}, {_PATCH_RMSE} SELECT scenario, count(*) AS n_patches, round(avg(rmse), 6) AS rmse, round(sum(rmse * n) / sum(n), 6) AS rmse_weighted FROM p GROUP BY scenario")
def p15_patch_mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    patch = S.metrics_of_sums(S.patch_global_stats(cells(spark, sf), KEYS), KEYS)
    return rounded(S.patch_mean_metrics(patch, ["rmse"], ["scenario"]))


_TN = _n(f"NOT {_PW} AND NOT {_TW}")


@query(f"{CELLS_SQL} SELECT scenario, {_TP} AS tp, {_FP} AS fp, {_FN} AS fn, {_TN} AS tn, round({_ratio(_TP, f'{_TP} + {_FP} + {_FN}')}, 6) AS csi, round({_ratio(_TP, f'{_TP} + {_FP}')}, 6) AS precision, round({_ratio(_TP, f'{_TP} + {_FN}')}, 6) AS recall, round({_ratio(_TN, f'{_TN} + {_FN}')}, 6) AS dry_precision, round({_ratio(_TN, f'{_TN} + {_FP}')}, 6) AS dry_recall, round({_ratio(f'{_TP} + {_FP}', _N)}, 6) AS pred_prevalence, round({_ratio(f'{_TP} + {_FN}', _N)}, 6) AS target_prevalence FROM cells GROUP BY scenario")
def p16_confusion_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.confusion_full(cells(spark, sf), ["scenario"], 0.1))


_COARSE = f"coarse AS (SELECT {', '.join(KEYS)}, y // 2 AS cy, x // 2 AS cx, avg(target) AS value FROM cells GROUP BY ALL)"
_UP = f"up AS (SELECT c.*, k.value AS nearest FROM cells c JOIN coarse k ON {' AND '.join(f'c.{k} = k.{k}' for k in KEYS)} AND c.y // 2 = k.cy AND c.x // 2 = k.cx)"


@query(f"{CELLS_SQL}, {_COARSE}, {_UP} SELECT scenario, round(sqrt(sum(CASE WHEN mask = 1 THEN (nearest - target) * (nearest - target) ELSE 0 END) / (sum(mask) + {_EPS})), 6) AS rmse FROM up GROUP BY scenario")
def p17_coarse_baseline_nearest(spark: SparkSession, sf: str) -> DataFrame:
    fine = cells(spark, sf)
    coarse = block_mean(fine, KEYS, 2, "target").withColumnRenamed("target", "value")
    out = patchwise.coarse_baseline_scores(coarse, fine.drop("pred"), KEYS, 2, {"rmse": {"type": "rmse"}}, ["scenario"])
    return rounded(out)


_AX = "ax AS (SELECT f, s.c AS low, least(s.c + 1, 3) AS high, s.p - s.c AS part FROM (SELECT f, greatest((f + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0) AS p, CAST(floor(greatest((f + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0)) AS INT) AS c FROM (SELECT unnest(range(8)) AS f)) s)"
_AXIS = "aw AS (SELECT f, c, sum(w) AS w FROM (SELECT f, low AS c, 1 - part AS w FROM ax UNION ALL SELECT f, high, part FROM ax) GROUP BY f, c)"


@query(f"{CELLS_SQL}, {_COARSE}, {_AX}, {_AXIS}, up AS (SELECT {', '.join(KEYS)}, a.f AS y, b.f AS x, sum(value * a.w * b.w) AS pred FROM coarse JOIN aw a ON a.c = cy JOIN aw b ON b.c = cx GROUP BY ALL) SELECT c.scenario, round(sqrt(sum(CASE WHEN mask = 1 THEN (u.pred - target) * (u.pred - target) ELSE 0 END) / (sum(mask) + {_EPS})), 6) AS rmse FROM cells c JOIN up u ON {' AND '.join(f'c.{k} = u.{k}' for k in [*KEYS, 'y', 'x'])} GROUP BY c.scenario")
def p17_coarse_baseline_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    """Patches stay rows: made coarse, then fine again, without a shuffle."""
    v = vectors(spark, sf).select(*KEYS, "target", "mask", F.lit(8).alias("h"), F.lit(8).alias("w"))
    coarse = resize_patches(v, 8, 8, 2, "mean", "target", "coarse")
    fine = resize_patches(coarse, 4, 4, 2, "bilinear", "coarse", "pred").drop("coarse")
    return rounded(S.score(patches_to_cells(fine, {"pred": "pred", "target": "target", "mask": "mask"}), {"rmse": {"type": "rmse"}}, ["scenario"]))


_LAYERS = ("coarse", "target", "pred", "error", "square")
# a block of the coarse grid counts where any of its fine cells does
_LONG = f"""long AS (
  SELECT scenario, unnest(['target', 'pred', 'error', 'square']) AS layer, unnest([target, pred, {_D}, {_D} * {_D}]) AS v FROM cells WHERE mask = 1
  UNION ALL SELECT scenario, 'coarse', v FROM (SELECT scenario, avg(target) AS v, max(mask) AS mask FROM cells GROUP BY {', '.join(KEYS)}, y // 2, x // 2) WHERE mask = 1
)"""


def _reports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Distributions of the coarse map, both fine ones, their error and its square."""
    fine = cells(spark, sf)
    layers = fine.withColumns({"error": F.col("pred") - F.col("target"), "square": (F.col("pred") - F.col("target")) * (F.col("pred") - F.col("target"))})
    two = {"y": F.floor(F.col("y") / 2), "x": F.floor(F.col("x") / 2)}
    coarse = fine.withColumns(two).groupBy(*KEYS, "y", "x").agg(F.avg("target").alias("coarse"), F.max("mask").alias("mask"))
    both = [patchwise.distribution_report(layers, ["scenario"], list(_LAYERS[1:])), patchwise.distribution_report(coarse, ["scenario"], ["coarse"])]
    return both[0][0].unionByName(both[1][0]), both[0][1].unionByName(both[1][1])


@query(f"{CELLS_SQL}, {_LONG} SELECT scenario, layer, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v) + {_EPS}, 6) AS std, [round(q, 6) FOR q IN quantile_cont(v, [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1])] AS percentiles FROM long GROUP BY scenario, layer")
def p18_distribution_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_reports(spark, sf)[0])


@query(f"{CELLS_SQL}, {_LONG}, e AS (SELECT scenario, layer, min(v) AS low, max(v) AS high FROM long GROUP BY ALL), b AS (SELECT l.scenario, l.layer, low, high, CASE WHEN high > low THEN least(floor((v - low) / (high - low) * 50), 49) ELSE 0 END::INT AS bin FROM long l JOIN e ON l.scenario = e.scenario AND l.layer = e.layer) SELECT scenario, layer, round(low, 6) AS low, round(high, 6) AS high, bin, count(*) AS n FROM b GROUP BY ALL")
def p18_distribution_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_reports(spark, sf)[1])


_AL = f"al AS (SELECT {', '.join(KEYS)}, cy, cx, avg(target) AS target, avg(pred) AS pred FROM (SELECT *, y // 2 AS cy, x // 2 AS cx FROM cells) GROUP BY ALL)"


@query(f"{CELLS_SQL}, {_AL}, p AS (SELECT {', '.join(KEYS)}, avg(abs(pred - target)) AS mae, greatest(avg((pred >= 0.1::DOUBLE)::INT), avg((target >= 0.1::DOUBLE)::INT)) AS wet, (count(*) FILTER (WHERE pred >= 0.1::DOUBLE AND target >= 0.1::DOUBLE))::DOUBLE / ((count(*) FILTER (WHERE pred >= 0.1::DOUBLE OR target >= 0.1::DOUBLE)) + {_EPS}) AS csi FROM al GROUP BY ALL) SELECT {', '.join(KEYS)}, round(mae, 6) AS mae, round(wet, 6) AS wet, round(csi, 6) AS csi FROM p WHERE wet >= 0.01")
def p19_alignment_scores(spark: SparkSession, sf: str) -> DataFrame:
    fine = cells(spark, sf)
    coarse = block_mean(fine, KEYS, 2, "pred").withColumnRenamed("pred", "value")
    out = patchwise.alignment_scores(fine.withColumnRenamed("target", "value").select(*KEYS, "y", "x", "value"), coarse, KEYS, 2, 0.1)
    return rounded(out.select(*KEYS, "mae", "wet", "csi"))


_SH = ", ".join(KEYS)


@query(f"""{CELLS_SQL}, sh AS (SELECT unnest(range(-3, 4)) AS dy), sh2 AS (SELECT dy, unnest(range(-3, 4)) AS dx FROM sh),
pairs AS (SELECT {', '.join(f'a.{k}' for k in KEYS)}, dy, dx, a.target >= 0.1::DOUBLE AS p, b.pred >= 0.1::DOUBLE AS q
  FROM sh2, cells a JOIN cells b ON {' AND '.join(f'a.{k} = b.{k}' for k in KEYS)} AND b.y = a.y + dy AND b.x = a.x + dx AND b.mask = 1),
s AS (SELECT {_SH}, dy, dx, coalesce(count(*) FILTER (WHERE p AND q) / nullif(count(*) FILTER (WHERE p OR q), 0), 0) AS csi FROM pairs GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY {_SH} ORDER BY round(csi, 10) DESC, dy, dx) AS n FROM s)
SELECT {_SH}, round(csi, 6) AS csi, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx FROM best WHERE n = 1""")
def p20_best_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Over all 49 shifts."""
    v = vectors(spark, sf).select(*KEYS, F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("target").alias("fine"), F.col("pred").alias("coarse"), "mask")
    return rounded(patchwise.best_shift(v, 0.1, 3).select(*KEYS, "csi", "dy", "dx"))


def _mean_loss(value: str) -> str:
    return f"{CELLS_SQL}, p AS (SELECT {', '.join(KEYS)}, sum(mask * {value}) / sum(mask) AS loss FROM cells GROUP BY ALL HAVING sum(mask) > 0) SELECT scenario, round(avg(loss), 6) AS loss FROM p GROUP BY scenario"


@query(_mean_loss(f"abs({_D})"))
def p21_masked_l1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.masked_l1(cells(spark, sf), KEYS).groupBy("scenario").agg(F.avg("loss").alias("loss")))


@query(_mean_loss(f"{_D} * {_D}"))
def p21_masked_l2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.masked_l2(cells(spark, sf), KEYS).groupBy("scenario").agg(F.avg("loss").alias("loss")))


@query(f"{CELLS_SQL} SELECT scenario, round(avg(sqrt({_D} * {_D} + 1e-12::DOUBLE)), 6) AS loss FROM cells GROUP BY scenario")
def p21_charbonnier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.charbonnier(cells(spark, sf), ["scenario"]))


_EXCESS = "greatest(target - 0.1::DOUBLE, 0)"
_WEIGHT = "least(greatest(1 + 2 * (target >= 0.1::DOUBLE)::INT + 0.5::DOUBLE * {g}, 1.2::DOUBLE), 3.4::DOUBLE)"


def _weighted(spark: SparkSession, sf: str, mode: str, power: int = 1) -> DataFrame:
    loss = S.weighted_loss(cells(spark, sf), KEYS, 0.1, wet_weight=2.0, excess_weight=0.5, mode=mode, power=power, scale=0.4, gamma=1.5, least=1.2, most=3.4)
    return rounded(loss.groupBy("scenario").agg(F.avg("loss").alias("loss")))


@query(_mean_loss(f"abs({_D}) * {_WEIGHT.format(g=_EXCESS)}"))
def p22_weighted_l1(spark: SparkSession, sf: str) -> DataFrame:
    return _weighted(spark, sf, "linear")


@query(_mean_loss(f"abs({_D}) * {_WEIGHT.format(g=f'(1 - exp(-{_EXCESS} / 0.4::DOUBLE))')}"))
def p22_weighted_l1_exp(spark: SparkSession, sf: str) -> DataFrame:
    return _weighted(spark, sf, "exp")


@query(_mean_loss(f"{_D} * {_D} * {_WEIGHT.format(g=f'pow({_EXCESS} / 0.4::DOUBLE, 1.5::DOUBLE)')}"))
def p22_weighted_l2_power(spark: SparkSession, sf: str) -> DataFrame:
    return _weighted(spark, sf, "power", 2)


def _selected_loss(value: str, chosen: str) -> str:
    """The mean over patches of a sum over the masked cells by the number of chosen ones."""
    return (
        f"{CELLS_SQL}, p AS (SELECT {', '.join(KEYS)}, sum(mask * ({value})) AS v, {_n(chosen)} AS w FROM cells GROUP BY ALL)"
        " SELECT scenario, round(avg(v / w), 6) AS loss FROM p WHERE w > 0 GROUP BY scenario"
    )


_BAND = "target >= 0.0::DOUBLE AND target <= 0.3::DOUBLE"
_GAUSS = f"abs({_D}) * exp(-0.5::DOUBLE * pow((target - 0.1::DOUBLE) / (0.7::DOUBLE * 0.15::DOUBLE + {_EPS}), 2))"


def _per_scenario(loss: DataFrame) -> DataFrame:
    return rounded(loss.groupBy("scenario").agg(F.avg("loss").alias("loss")))


@query(_selected_loss(f"CASE WHEN {_BAND} THEN {_GAUSS} ELSE 0 END", _BAND))
def p23_band_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _per_scenario(S.band_loss(cells(spark, sf), KEYS, 0.1, 0.2, "gaussian", sigma_ratio=0.7))


@query(_selected_loss(_GAUSS, _BAND))
def p23_band_loss_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The Gaussian is not cut at the band's edges."""
    return _per_scenario(S.band_loss(cells(spark, sf), KEYS, 0.1, 0.2, "gaussian", sigma_ratio=0.7, truncate=False))


@query(_selected_loss(f"CASE WHEN {_BT} THEN CASE WHEN abs(pred - target) < 0.1::DOUBLE THEN 0.5::DOUBLE * (pred - target) * (pred - target) / 0.1::DOUBLE ELSE abs(pred - target) - 0.05::DOUBLE END ELSE 0 END", _BT))
def p24_range_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _per_scenario(S.range_loss(cells(spark, sf), KEYS, 0.1, 0.5, "smooth_l1", 0.1))


def _bce(c: str, t: str, pos: str = "1") -> str:
    y = f"(target >= {t}::DOUBLE)::INT"
    soft = f"ln(1 + exp(-abs({c})))"
    return f"({pos} * {y} * (greatest(-{c}, 0) + {soft}) + (1 - {y}) * (greatest({c}, 0) + {soft}))"


@query(_mean_loss(_bce("l1", "0.1")))
def p25_bce_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _per_scenario(S.bce_loss(cells(spark, sf), KEYS, "l1", 0.1))


_Y, _P = "(target >= 0.1::DOUBLE)::INT", "(1 / (1 + exp(-l1)))"


@query(_mean_loss(f"{_bce('l1', '0.1', '3')} * pow(1 - ({_Y} * {_P} + (1 - {_Y}) * (1 - {_P})), 2) * (0.75::DOUBLE * {_Y} + 0.25::DOUBLE * (1 - {_Y}))"))
def p25_focal_bce_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _per_scenario(S.bce_loss(cells(spark, sf), KEYS, "l1", 0.1, pos_weight=3.0, focal=2.0))


@query(_mean_loss(f"({_bce('l1', '0.1')} + 2 * {_bce('l2', '0.5')} + 0.5::DOUBLE * {_bce('l3', '1.0')})"))
def p25_ordinal_bce_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _per_scenario(S.ordinal_bce_loss(cells(spark, sf), KEYS, (0.1, 0.5, 1.0), weights=(1.0, 2.0, 0.5)))


@query(f"{CELLS_SQL}, p AS (SELECT {', '.join(KEYS)}, sum(mask * ({_P} - {_Y})) / sum(mask) AS gap FROM cells GROUP BY ALL HAVING sum(mask) > 0) SELECT scenario, round(avg(gap * gap), 6) AS loss FROM p GROUP BY scenario")
def p25_prevalence_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _per_scenario(S.prevalence_loss(cells(spark, sf), KEYS, "l1", 0.1))


@query(f"{CELLS_SQL}, d AS (SELECT {', '.join(KEYS)}, abs(lead(target) OVER (PARTITION BY {', '.join(KEYS)}, x ORDER BY y) - target) AS d, abs(lead(target) OVER (PARTITION BY {', '.join(KEYS)}, y ORDER BY x) - target) AS r FROM cells) SELECT {', '.join(KEYS)}, round(avg(d) + avg(r), 6) AS tv FROM d GROUP BY ALL")
def p26_tv_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tv_of_patches(vectors(spark, sf).select(*KEYS, "target"), 8, 8, "target").select(*KEYS, "tv"))


@query(f"{CELLS_SQL}, m AS (SELECT {', '.join(KEYS)}, avg({_D} * {_D}) AS mse FROM cells GROUP BY ALL) SELECT {', '.join(KEYS)}, round(mse, 6) AS mse, mse = 0 AS equal, round(CASE WHEN mse > 0 THEN 10 * log10(25 / mse) END, 6) AS psnr FROM m")
def p27_psnr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.psnr(cells(spark, sf), KEYS, "pred", "target", 5.0))


_TAPS = "exp(-(k - 5) * (k - 5) / 4.5::DOUBLE)"
_K = ", ".join(KEYS)
_FIVE = "sum(w * ma) AS ma, sum(w * mb) AS mb, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab"


@query(f"""{CELLS_SQL}, g AS (SELECT k, {_TAPS} / (SELECT sum({_TAPS}) FROM range(11) r(k)) AS w FROM range(11) r(k)),
big AS (SELECT {_K}, y * 2 + dy AS y, x * 2 + dx AS x, target AS ma, pred AS mb, target * target AS aa, pred * pred AS bb, target * pred AS ab FROM cells, range(2) a(dy), range(2) b(dx)),
h AS (SELECT {_K}, y, x - k AS c, {_FIVE} FROM big JOIN g ON x - k BETWEEN 0 AND 5 GROUP BY ALL),
v AS (SELECT {_K}, y - k AS r, c, {_FIVE} FROM h JOIN g ON y - k BETWEEN 0 AND 5 GROUP BY ALL)
SELECT {_K}, round(avg(((2 * ma * mb + 0.0025::DOUBLE) * (2 * (ab - ma * mb) + 0.0225::DOUBLE)) / ((ma * ma + mb * mb + 0.0025::DOUBLE) * (aa - ma * ma + bb - mb * mb + 0.0225::DOUBLE))), 6) AS ssim FROM v GROUP BY ALL""")
def p28_ssim(spark: SparkSession, sf: str) -> DataFrame:
    """Patches doubled to 16 x 16, since the window needs 11 cells."""
    double = lambda c: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.get(c, (F.floor(i / 32) * 8 + F.floor((i % 16) / 2)).cast("int")))
    v = vectors(spark, sf).select(*KEYS, F.lit(16).alias("h"), F.lit(16).alias("w"), double("target").alias("a"), double("pred").alias("b"))
    return rounded(patchwise.ssim(v, KEYS, most=5.0))


_BW = f"{CELLS_SQL}, {_PATCH_RMSE}"


@query(f"{_BW}, r AS (SELECT scenario, t, patch_row, patch_col, rmse, row_number() OVER (PARTITION BY scenario ORDER BY rmse, t, patch_row, patch_col) AS lo, row_number() OVER (PARTITION BY scenario ORDER BY rmse DESC, t, patch_row, patch_col) AS hi FROM p) SELECT a.scenario, 'rmse' AS metric, 'lower' AS better, round(a.rmse, 6) AS best, a.t AS best_t, round(b.rmse, 6) AS worst, b.t AS worst_t FROM r a JOIN r b ON a.scenario = b.scenario AND a.lo = 1 AND b.hi = 1")
def w2_best_worst(spark: SparkSession, sf: str) -> DataFrame:
    patch = S.metrics_of_sums(S.patch_global_stats(cells(spark, sf), KEYS), KEYS)
    out = sampling.best_worst(patch, {"rmse": "lower"}, KEYS[1:], ["scenario"])
    return rounded(out.select("scenario", "metric", "better", "best", F.col("best_ids.t").alias("best_t"), "worst", F.col("worst_ids.t").alias("worst_t")))


@query(_by(["scenario"], {"rmse": f"sqrt({_ratio(_SSE(_D), _N)})", "csi": _ratio(_TP, f"{_TP} + {_FP} + {_FN}"), "nse": f"1 - {_SSE(_D)} / ({_SST} + {_EPS})"}, WIDE_SQL))
def z1_score(spark: SparkSession, sf: str) -> DataFrame:
    config = {"rmse": {"type": "rmse", "better": "lower"}, "csi": {"type": "event", "kind": "csi", "threshold": 0.1, "better": "higher"}, "nse": {"type": "nse", "better": "higher"}}
    return rounded(S.score(wide_cells(spark, sf), config, ["scenario"]))
