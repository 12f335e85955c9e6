"""Detector parameters, their search space, and value sets by name."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields, replace

SIDES = ("high", "low")


@dataclass(frozen=True)
class SideParams:
    """Parameters of one side; the defaults are the HIGH side's."""

    S_detect: int = 12
    scale_start: int = 3
    scale_end: int = 270
    scale_step: int = 3
    min_duration: int = 13
    cooldown_bars: int = 9
    price_gate_lb: int = 23
    vola_range_len: int = 120
    er_period: int = 28
    pct_extreme: float = 0.96
    min_agreement: float = 0.75
    dur_extreme_pct: float = 0.83
    confirm_count: int = 5
    vol_surge_thresh: float = 1.5
    scale_div_thresh: float = 0.35
    slope_thresh: float = 0.22
    vola_high_pct: float = 0.92
    pivot_drift_lookback: int = 5
    pivot_drift_thresh: float = 0.008
    pivot_drift_gate_mult: float = 8.0
    pivot_drift_confirm_bias: int = 1
    momentum_velocity_thresh: float = 0.014
    gjr_vote_thresh: float = 0.15
    har_vote_thresh: float = 0.15
    er_directional: bool = False
    use_trend: bool = False
    use_volume: bool = False
    use_momentum: bool = False
    use_momentum_velocity: bool = True
    use_volatility: bool = False
    use_er_gate: bool = False
    use_gjr_asym: bool = False
    use_har_vol: bool = False
    vola_method: str = "ATR"
    momentum_velocity_mode: str = "Reversal"
    use_edge_voting: bool = False
    edge_window: int = 5


# The LOW side's defaults.
DEFAULT_LOW = SideParams(
    S_detect=26, scale_start=19, scale_end=250, scale_step=15, min_duration=2, cooldown_bars=7, price_gate_lb=58,
    vola_range_len=20, er_period=47, pct_extreme=0.85, min_agreement=0.30, dur_extreme_pct=0.72, confirm_count=3,
    vol_surge_thresh=2.2, scale_div_thresh=0.39, slope_thresh=0.15, vola_high_pct=0.78, pivot_drift_lookback=10,
    pivot_drift_thresh=0.005, pivot_drift_gate_mult=4.0, pivot_drift_confirm_bias=0, momentum_velocity_thresh=0.007,
    use_volatility=True,
)


@dataclass(frozen=True)
class Params:
    high: SideParams = field(default_factory=SideParams)
    low: SideParams = DEFAULT_LOW
    baseline_lb: int = 20

    def side(self, side: str) -> SideParams:
        if side not in SIDES:
            raise ValueError(f"side must be 'high' or 'low', got {side!r}")
        return getattr(self, side)

    def with_side(self, side: str, **values) -> Params:
        return replace(self, **{side: replace(self.side(side), **values)})

    def to_dict(self) -> dict:
        """Flat names, ``{side}_{field}``."""
        return {f"{s}_{k}": v for s in SIDES for k, v in asdict(self.side(s)).items()} | {"baseline_lb": self.baseline_lb}


_MIDDLE = SideParams(
    scale_start=5, scale_end=60, scale_step=5, pct_extreme=0.85, min_agreement=0.50, dur_extreme_pct=0.50, min_duration=2,
    scale_div_thresh=0.60, price_gate_lb=10, cooldown_bars=8, confirm_count=1,
)
_PERMISSIVE = SideParams(
    scale_start=3, scale_end=45, scale_step=3, pct_extreme=0.80, min_agreement=0.40, dur_extreme_pct=0.40, min_duration=1,
    scale_div_thresh=0.60, price_gate_lb=5, cooldown_bars=5, confirm_count=1, momentum_velocity_thresh=0.0,
)
PRESETS = {"default": Params(), "middle": Params(_MIDDLE, _MIDDLE), "permissive": Params(_PERMISSIVE, _PERMISSIVE)}

# Bounds of the search.
INT_BOUNDS = {
    "S_detect": (5, 60), "scale_start": (2, 30), "scale_end": (100, 500), "scale_step": (2, 20), "min_duration": (1, 20),
    "cooldown_bars": (1, 20), "price_gate_lb": (5, 100), "vola_range_len": (20, 200), "er_period": (5, 60),
    "confirm_count": (1, 5), "pivot_drift_lookback": (2, 20), "pivot_drift_confirm_bias": (0, 2), "edge_window": (3, 60),
}
FLOAT_BOUNDS = {
    "pct_extreme": (0.70, 0.99), "min_agreement": (0.10, 0.90), "dur_extreme_pct": (0.50, 0.99), "vol_surge_thresh": (1.0, 3.0),
    "scale_div_thresh": (0.10, 0.60), "slope_thresh": (0.01, 0.50), "vola_high_pct": (0.50, 0.99), "pivot_drift_thresh": (0.001, 0.050),
    "pivot_drift_gate_mult": (1.0, 10.0), "momentum_velocity_thresh": (0.0, 0.05), "gjr_vote_thresh": (0.05, 0.50), "har_vote_thresh": (0.05, 0.50),
}
HIGH_FLOORS = {"dur_extreme_pct": 0.30, "pct_extreme": 0.55}
BOOLS = tuple(f.name for f in fields(SideParams) if f.type == "bool")
CATEGORIES = {"vola_method": ("ATR", "StdDev", "Intraday"), "momentum_velocity_mode": ("Trend", "Reversal")}
TRIAL_NAMES = {"pivot_drift_lookback": "pivot_drift_lb"}

#: Threshold fields that are always searched, and those that a vote switches on.
THRESHOLDS = ("pct_extreme", "min_agreement", "dur_extreme_pct", "scale_div_thresh", "pivot_drift_thresh", "pivot_drift_gate_mult")
VOTE_THRESHOLDS = {
    "use_volume": "vol_surge_thresh", "use_trend": "slope_thresh", "use_volatility": "vola_high_pct",
    "use_momentum_velocity": "momentum_velocity_thresh", "use_gjr_asym": "gjr_vote_thresh", "use_har_vol": "har_vote_thresh",
}


@dataclass(frozen=True)
class SearchSpace:
    ints: dict
    floats: dict
    bools: tuple = BOOLS
    categories: dict = field(default_factory=lambda: dict(CATEGORIES))


def space_for(side: str) -> SearchSpace:
    if side not in SIDES:
        raise ValueError(f"side must be 'high' or 'low', got {side!r}")
    floors = HIGH_FLOORS if side == "high" else {}
    return SearchSpace(dict(INT_BOUNDS), {k: (floors.get(k, lo), hi) for k, (lo, hi) in FLOAT_BOUNDS.items()})


def trial_key(side: str, name: str) -> str:
    return f"{side}_{TRIAL_NAMES.get(name, name)}"


def params_from_trial(trial: dict, side: str, base: Params = Params()) -> Params:
    """The side's values of a trial; the other side stays."""
    known = {f.name for f in fields(SideParams)}
    return base.with_side(side, **{k: trial[trial_key(side, k)] for k in known if trial_key(side, k) in trial})


def active_thresholds(p: SideParams) -> list[str]:
    return [*THRESHOLDS, *(name for switch, name in VOTE_THRESHOLDS.items() if getattr(p, switch))]


def sample_global(side: str, rng: random.Random) -> dict:
    """A uniform draw from the whole space."""
    space = space_for(side)
    out: dict = {k: rng.randint(lo, hi) for k, (lo, hi) in space.ints.items()}
    out |= {k: rng.uniform(lo, hi) for k, (lo, hi) in space.floats.items()}
    out |= {k: rng.random() < 0.5 for k in space.bools}
    return out | {k: rng.choice(v) for k, v in space.categories.items()}


def sample_local(side: str, at: SideParams, rng: random.Random, share: float = 0.10, flip: float = 0.15) -> dict:
    """A draw near ``at``: a tenth of each range to either side, and a few switches turned."""
    space, out = space_for(side), {}
    for k, (lo, hi) in space.ints.items():
        reach = max(1, round(share * (hi - lo)))
        out[k] = min(hi, max(lo, getattr(at, k) + rng.randint(-reach, reach)))
    for k, (lo, hi) in space.floats.items():
        out[k] = min(hi, max(lo, getattr(at, k) + rng.uniform(-share, share) * (hi - lo)))
    for k in space.bools:
        out[k] = getattr(at, k) ^ (rng.random() < flip)
    for k, v in space.categories.items():
        out[k] = rng.choice(v) if rng.random() < flip else getattr(at, k)
    return out


def draws(side: str, at: SideParams, n_local: int, n_global: int, seed: int) -> Iterator[tuple[str, dict]]:
    near, far = random.Random(seed), random.Random(seed ^ 0xA17EBA5E)
    for _ in range(n_local):
        yield "local", sample_local(side, at, near)
    for _ in range(n_global):
        yield "global", sample_global(side, far)
