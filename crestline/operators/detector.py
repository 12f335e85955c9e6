"""The turning-point detector: features, gates and votes, then cooldown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import windows as W
from ..functions.volmodels import gjr_norm, har_norm
from ..functions.windows import Slice, is_true
from ..plans.params import Params, SideParams
from .agreement import agreement, scale_grid
from .labels import baseline_pivots
from .state import cooled, duration, mark_signals, pivot_drift


def max_votes(p: SideParams) -> int:
    """Votes that can be asked for; the drift vote counts, but is not among them."""
    return sum((p.use_trend, p.use_volume, p.use_momentum, p.use_momentum_velocity, p.use_volatility, p.use_gjr_asym, p.use_har_vol))


def shape_features(df: DataFrame, s: Slice, params: Params, sides: tuple[str, ...] = ("high", "low")) -> DataFrame:
    """All features that thresholds are held against; they depend on lookbacks alone, but for agreement and its extreme.

    Features of votes that no side uses are left out.
    """
    df = baseline_pivots(df, s, params.baseline_lb)
    df = pivot_drift(df, s, {f"drift_{x}": params.side(x).pivot_drift_lookback for x in sides})
    if any(params.side(x).use_har_vol for x in sides):
        df = har_norm(df, s)
    if any(params.side(x).use_gjr_asym for x in sides):
        df = gjr_norm(df, s)
    grids: dict[tuple, dict] = {}
    for x in sides:
        p = params.side(x)
        grids.setdefault((p.scale_start, p.scale_end, p.scale_step), {})[f"agree_{x}"] = (x == "high", p.pct_extreme)
    for grid, wanted in grids.items():
        df = agreement(df, s, scale_grid(*grid), wanted)
    for x in sides:
        p, n = params.side(x), params.side(x).S_detect
        df = W.sma(df, s, "close", n, "__mean").withColumn("__rel", W.ratio(F.col("close"), F.col("__mean")))
        df = W.pir(df, s, "__rel", max(n, 20), f"position_{x}").drop("__mean", "__rel")
        if p.use_trend:
            df = W.trend(df, s, n, f"slope_{x}", f"line_{x}")
        if p.use_volume:
            df = W.volume_surge(df, s, n, f"surge_{x}")
        if p.use_momentum or p.use_momentum_velocity:
            df = W.momentum(df, s, n, f"divergence_{x}", f"velocity_{x}")
        if p.use_volatility:
            df = W.volatility_position(df, s, p.vola_method, n, p.vola_range_len, f"vola_{x}")
        if p.use_er_gate:
            df = W.efficiency_ratio(df, s, p.er_period, f"er_{x}", p.er_directional)
        price = "high" if x == "high" else "low"
        df = df.withColumn(f"reached_{x}", W.price_gate(s, price, p.price_gate_lb, x == "high"))
    return df


def _raw_votes(x: str, p: SideParams) -> list[Column]:
    high, c = x == "high", F.col
    v = []
    if p.use_trend:
        up = (c(f"slope_{x}") > p.slope_thresh) & (c(f"line_{x}") > p.slope_thresh)
        down = (c(f"slope_{x}") < -p.slope_thresh) & (c(f"line_{x}") < -p.slope_thresh)
        v.append(up if high else down)
    v.append(c(f"drift_{x}") < -p.pivot_drift_thresh if high else c(f"drift_{x}") > p.pivot_drift_thresh)
    if p.use_volume:
        v.append(c(f"surge_{x}") < 1.0 / p.vol_surge_thresh if high else c(f"surge_{x}") > p.vol_surge_thresh)
    if p.use_momentum:
        v.append(c(f"divergence_{x}") < 0)
    if p.use_momentum_velocity:
        t = abs(p.momentum_velocity_thresh)
        falls = high == (p.momentum_velocity_mode == "Reversal")
        v.append(c(f"velocity_{x}") <= -t if falls else c(f"velocity_{x}") >= t)
    if p.use_volatility:
        v.append(c(f"vola_{x}") > p.vola_high_pct)
    if p.use_gjr_asym:
        v.append(c("gjr_norm") <= -p.gjr_vote_thresh if high else c("gjr_norm") >= p.gjr_vote_thresh)
    if p.use_har_vol:
        v.append(c("har_norm") >= p.har_vote_thresh)
    return [is_true(x) for x in v]


def apply_thresholds(df: DataFrame, s: Slice, x: str, p: SideParams, suffix: str = "") -> DataFrame:
    """``gate_``, ``votes_``, ``required_`` and ``candidate_`` of a side from its features."""
    high, c = x == "high", F.col
    df = duration(df, s, c(f"agree_{x}") > p.dur_extreme_pct, "__dur")
    raw = _raw_votes(x, p)
    names = [f"__v{i}" for i in range(len(raw))]
    df = df.withColumns({k: W.edge_or_state(s, v, p.edge_window, p.use_edge_voting) for k, v in zip(names, raw, strict=True)})
    position = c(f"position_{x}") if high else 1.0 - c(f"position_{x}")
    apart = is_true(F.abs(position - c(f"agree_{x}")) > p.scale_div_thresh)
    gate = c(f"reached_{x}") & (c(f"agree_{x}") >= p.min_agreement) & (c("__dur") >= p.min_duration) & ~apart
    if p.use_er_gate:
        df = df.withColumn("__er", W.er_gate(s, f"er_{x}"))
        gate = gate & c("__er")
    if high:
        gate = gate & ~(c(f"drift_{x}") > p.pivot_drift_thresh * p.pivot_drift_gate_mult)
    up = (c(f"drift_{x}") > p.pivot_drift_thresh).cast("int") * p.pivot_drift_confirm_bias
    asked = F.lit(p.confirm_count) + (up if high else -up)
    required = F.greatest(F.least(asked, F.lit(max(max_votes(p), 1))), F.lit(1))
    votes = reduce(lambda a, b: a + b, [c(n).cast("int") for n in names])
    df = df.withColumns({f"duration_{x}{suffix}": c("__dur"), f"gate_{x}{suffix}": gate, f"votes_{x}{suffix}": votes, f"required_{x}{suffix}": required})
    candidate = c(f"gate_{x}{suffix}") & (c(f"votes_{x}{suffix}") >= c(f"required_{x}{suffix}"))
    return df.withColumn(f"candidate_{x}{suffix}", candidate).drop("__dur", "__er", *names)


def candidates(df: DataFrame, s: Slice, params: Params, sides: tuple[str, ...] = ("high", "low")) -> DataFrame:
    """Features, gates and votes of every bar."""
    df = shape_features(df, s, params, sides)
    for x in sides:
        df = apply_thresholds(df, s, x, params.side(x))
    return df


def detect(df: DataFrame, s: Slice, params: Params, sides: tuple[str, ...] = ("high", "low"), debug: bool = False) -> DataFrame:
    """Every bar with ``signal_high`` and ``signal_low``, and the pivots that are known on it; ``debug`` keeps features."""
    kept = df.columns
    full = candidates(df, s, params, sides)
    if not debug:
        full = full.select(*kept, "baseline_high", "baseline_low", *(f"candidate_{x}" for x in sides))
    return mark_signals(full, s, {f"signal_{x}": (f"candidate_{x}", params.side(x).cooldown_bars) for x in sides})


def signals(df: DataFrame, s: Slice, params: Params, x: str) -> DataFrame:
    """(keys, bar) of a side's signals."""
    return cooled(candidates(df, s, params, (x,)), s, f"candidate_{x}", params.side(x).cooldown_bars)
