"""Scalar functions: each takes and returns Columns, and stays inside generated code.

Missing values are NULL throughout: ``operators.cells.mask_fill`` turns NaN, infinities and fill
values into NULL once, at ingest, and no function here gives NaN back for NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to denominators, as in the published formulas.
EPS = 1e-12
#: ``100y_48h_0c``: return period, duration in hours, warming.
SCENARIO = r"\d+y_\d+h_\d+c"
CORE_KEY = r"^([A-Za-z]+)_(\d+y_\d+h_\d+c)_(t\d+)_r(\d+)_c(\d+)_s(\d+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("double")


def finite(c: Column | str) -> Column:
    """The value as double; NULL for NaN and infinities."""
    d = _c(c).cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def log1p_nonneg(c: Column | str) -> Column:
    return F.log1p(F.greatest(_c(c).cast("double"), F.lit(0.0)) + _c(c) * 0)


def asinh_scale(c: Column | str, scale) -> Column:
    """asinh(x / s); a missing, non-finite or non-positive scale leaves x as it is."""
    s = finite(_num(scale))
    return F.when(s > 0, F.asinh(F.try_divide(_c(c).cast("double"), s))).otherwise(_c(c).cast("double"))


def zscore(c: Column | str, mean, std) -> Column:
    return (_c(c) - _num(mean)) / (_num(std) + EPS)


def minmax(c: Column | str, low, high) -> Column:
    return (_c(c) - _num(low)) / (_num(high) - _num(low) + EPS)


def percentile_clip(c: Column | str, low=None, high=None) -> Column:
    """Clipped to [low, high]; a missing bound doesn't clip, and NULL stays."""
    x = _c(c).cast("double")
    out = x
    if low is not None:
        out = F.when(out < _num(low), _num(low)).otherwise(out)
    if high is not None:
        out = F.when(out > _num(high), _num(high)).otherwise(out)
    return out


def normalise(c: Column | str, stats: dict, transform: str = "none", norm: str = "zscore") -> Column:
    """The transform (none, log1p, asinh with stats["s"]), then z-score or min-max by ``stats``."""
    x = {"none": lambda: _c(c).cast("double"), "log1p": lambda: log1p_nonneg(c), "asinh": lambda: asinh_scale(c, stats.get("s"))}[transform]()
    return {"none": lambda: x, "zscore": lambda: zscore(x, stats["mean"], stats["std"]), "minmax": lambda: minmax(x, stats["min"], stats["max"])}[norm]()


def to_physical(z: Column | str, stats: dict, transform: str = "none", norm: str = "zscore", nonneg: bool = False) -> Column:
    """The inverse of ``normalise``; ``nonneg`` clamps at 0, as for depths."""
    z = _c(z)
    if norm == "zscore":
        z = z * (_num(stats["std"]) + EPS) + _num(stats["mean"])
    elif norm == "minmax":
        z = z * (_num(stats["max"]) - _num(stats["min"]) + EPS) + _num(stats["min"])
    if transform == "log1p":
        z = F.expm1(z)
    elif transform == "asinh" and stats.get("s"):
        z = F.sinh(z) * _num(stats["s"])
    return F.when(z < 0, F.lit(0.0)).otherwise(z) if nonneg else z


def threshold_to_label_space(tau: float, stats: dict, transform: str = "none", norm: str = "zscore") -> Column:
    """A physical threshold as it appears among normalised labels."""
    return normalise(F.lit(float(tau)), stats, transform, norm)


def parse_core_key(c: Column | str) -> Column:
    """Struct (var, scenario, t, patch_row, patch_col, scale) of ``h_100y_48h_0c_t0000_r001_c002_s8...``; NULL if it doesn't match."""
    c = _c(c)
    part = lambda i: F.regexp_extract(c, CORE_KEY, i)
    return F.when(
        c.rlike(CORE_KEY),
        F.struct(
            part(1).alias("var"), part(2).alias("scenario"), part(3).alias("t"), part(4).try_cast("int").alias("patch_row"),
            part(5).try_cast("int").alias("patch_col"), part(6).try_cast("int").alias("scale"),
        ),
    )


def core_key(var, scenario, t, row, col, scale) -> Column:
    return F.format_string("%s_%s_%s_r%03d_c%03d_s%d", _c(var), _c(scenario), _c(t), _c(row), _c(col), _c(scale))


def parse_scenario(c: Column | str) -> Column:
    """Struct (ari, duration_h, warming_c) of a scenario name."""
    c = _c(c)
    part = lambda i: F.regexp_extract(c, r"(\d+)y_(\d+)h_(\d+)c", i).try_cast("int")
    return F.when(c.rlike(SCENARIO), F.struct(part(1).alias("ari"), part(2).alias("duration_h"), part(3).alias("warming_c")))


def infer_scenario(path: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(path), f"({SCENARIO})", 1), F.lit(""))


def time_tag(path: Column | str) -> Column:
    """``t0012`` of ``..._t0012...``."""
    return F.nullif(F.regexp_extract(_c(path), r"_(t\d{4})", 1), F.lit(""))


def time_sort_key(t: Column | str) -> Column:
    """The number in ``t12``; a tag without one sorts last."""
    return F.coalesce(F.regexp_extract(_c(t), r"t(\d+)", 1).try_cast("bigint"), F.lit((1 << 62)))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)/*$", 1)


def natural_key(path: Column | str) -> Column:
    """All whole numbers in the base name; arrays compare from left to right."""
    return F.transform(F.regexp_extract_all(base_name(path), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))


def rewrite_prefix(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The first rule (old, new) whose old prefix the value has replaces that prefix."""
    c = _c(c)
    out = None
    for old, new in rules:
        hit, value = c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return c if out is None else out.otherwise(c)


def resolve_path(c: Column | str, root: str) -> Column:
    """Relative paths under ``root``; blank and absolute ones as they are."""
    c = _c(c)
    return F.when((F.trim(c) == "") | c.startswith("/"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))


def scenario_template(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), SCENARIO, "{scenario}")


_UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


def decode_time(c: Column | str, unit: str, reference: Column | str) -> Column:
    """A number of units since a reference time, as a timestamp."""
    return F.timestamp_micros(F.unix_micros(_c(reference).cast("timestamp")) + F.round(_c(c).cast("double") * (_UNITS[unit] * 1_000_000)).cast("bigint"))


def seconds_since(ts: Column | str, reference: Column | str) -> Column:
    return (F.unix_micros(_c(ts).cast("timestamp")) - F.unix_micros(_c(reference).cast("timestamp"))) / F.lit(1_000_000.0)


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(c)))


def sigmoid_event(logit: Column | str, p: float = 0.5) -> Column:
    return sigmoid(logit) >= F.lit(p)


def ordinal_band(l1, l2, l3, p: float = 0.5) -> Column:
    """Struct of four booleans; they may overlap where the logits don't decrease."""
    a, b, c = (sigmoid_event(x, p) for x in (l1, l2, l3))
    return F.struct((~a).alias("nonflood"), (a & ~b).alias("slight"), (b & ~c).alias("severe"), c.alias("extreme"))


BANDS = ("nonflood", "slight", "severe", "extreme")


def depth_band(c: Column | str, t1: float, t2: float, t3: float, lower: float | None = None) -> Column:
    """Label of the left-closed band; ``lower`` bounds the first band (NULL below it)."""
    c = _c(c)
    first = c < t1 if lower is None else (c >= lower) & (c < t1)
    return F.when(first, "nonflood").when((c >= t1) & (c < t2), "slight").when((c >= t2) & (c < t3), "severe").when(c >= t3, "extreme")


def mismatch_class(a_wet: Column | str, b_wet: Column | str, mask: Column | str) -> Column:
    """0 invalid or both dry, 1 both wet, 2 only the first (coarse), 3 only the second (fine)."""
    a, b, m = (F.coalesce(_c(x).cast("boolean"), F.lit(False)) for x in (a_wet, b_wet, mask))
    return F.when(~m, 0).when(a & b, 1).when(a, 2).when(b, 3).otherwise(0)


def quantize(c: Column | str, low: float, high: float, levels: int) -> Column:
    """Clipped to [low, high] and floored to one of ``levels`` levels."""
    x = percentile_clip(c, low, high)
    return F.least(F.floor((x - low) / ((high - low) / levels)), F.lit(levels - 1)).cast("bigint") + (x * 0).cast("bigint")


def dequantize(c: Column | str, low: float, high: float, levels: int) -> Column:
    """The centre of a level."""
    return (_c(c) + 0.5) * ((high - low) / levels) + low


def parse_list(c: Column | str) -> Column:
    """Numbers of a comma list: ``NULL`` is -999, an empty entry -999.9, anything else unparsable NULL."""
    return F.transform(
        F.split(_c(c), ","),
        lambda x: F.when(F.trim(x) == "NULL", F.lit(-999.0)).when(F.trim(x) == "", F.lit(-999.9)).otherwise(F.trim(x).try_cast("double")),
    )


def wet(c: Column | str, threshold: float) -> Column:
    """value >= threshold; NULL is dry."""
    return F.coalesce(_c(c).cast("double") >= F.lit(float(threshold)), F.lit(False))


def ratio(num: Column, den: Column, empty: str = "zero") -> Column:
    """num / (den + 1e-12), or with ``empty="null"`` NULL where den is 0."""
    if empty not in ("zero", "null"):
        raise ValueError("empty must be zero or null")
    plain = F.coalesce(num, F.lit(0)) / (F.coalesce(den, F.lit(0)) + EPS)
    return plain if empty == "zero" else F.when(den > 0, num / den)
