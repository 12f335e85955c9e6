"""Parameters evaluated on folds, and pooled objectives."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.windows import Slice
from ..operators.detector import apply_thresholds, shape_features
from ..operators.scoring import bootstrap_lcb, greedy_matches, pooled_scores, tolerance
from ..operators.state import accepted
from .params import THRESHOLDS, VOTE_THRESHOLDS, Params, SideParams

#: Keys of a slice: every half of a stream in a fold has a warm-up of its own.
SLICE = ("fold", "stream_id", "half")


def check_shape(a: SideParams, b: SideParams) -> None:
    """Raises where parameters differ in more than what features are held against."""
    free = {*THRESHOLDS, *VOTE_THRESHOLDS.values(), "confirm_count", "cooldown_bars", "min_duration", "pivot_drift_confirm_bias"}
    changed = [f.name for f in fields(a) if getattr(a, f.name) != getattr(b, f.name) and f.name not in free]
    if changed:
        raise ValueError(f"not thresholds: {', '.join(changed)}")


def informative_folds(slices: DataFrame, side: str, label: str = "label") -> DataFrame:
    """Folds whose outside halves hold a pivot of the side; the others score nothing whatever the parameters."""
    sign = 1 if side == "high" else -1
    return slices.where((F.col("half") == "oos") & (F.col(label) == sign)).select("fold").distinct()


def features(slices: DataFrame, params: Params, side: str) -> DataFrame:
    """Features of all slices, to be kept while thresholds vary."""
    return shape_features(slices, Slice(SLICE), params, (side,))


def score_candidates(feats: DataFrame, side: str, candidates: Sequence[tuple[int, SideParams]], weights: DataFrame | None, n: int = 100, label: str = "label") -> DataFrame:
    """(candidate, fold, is_score, oos_score, oos_pivots, fold_score) of sets of thresholds over one feature table.

    Candidates differ in thresholds alone, so all of them are columns over the same
    features; one pass over a slice then cools and matches each of them.
    """
    s, sign, cap = Slice(SLICE), 1 if side == "high" else -1, tolerance(n)
    names = [(at, f"candidate_{side}_{at}", p.cooldown_bars) for at, p in candidates]
    df = feats
    for at, p in candidates:
        df = apply_thresholds(df, s, side, p, f"_{at}")
    df = df.select(*SLICE, "bar", label, *(c for _, c, _ in names))
    schema = "candidate int, fold int, stream_id string, half string, n_signals long, tp long, matched_pivots long, total_pivots long, n_bars long"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("bar")
        at = table.column("bar").to_numpy()
        pivots = at[table.column(label).to_numpy() == sign].tolist()
        rows = []
        for i, c, bars in names:
            hits = at[table.column(c).to_numpy(zero_copy_only=False).astype(bool)].tolist()
            kept = [hits[k] for k in accepted(hits, bars)]
            tp = greedy_matches(kept, pivots, cap)
            rows.append((i, *(k.as_py() for k in key), len(kept), tp, tp, len(pivots), len(at)))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    stats = df.groupBy(*SLICE).applyInArrow(run, schema)
    return pooled_scores(stats, weights, ["candidate", "fold"], n)


def objective(scores: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """(by, n_folds, mean_score, lcb, ucb) over informative folds; the lower bound is the objective."""
    return bootstrap_lcb(scores.where("oos_pivots > 0"), list(by))
