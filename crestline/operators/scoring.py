"""Signals against labels: matching, side, fold and pooled scores, and the bootstrap's lower bound."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# Fixed values of the score.
LEAD_BARS = 2
PRECISION_EXPONENT = 1.2
RECALL_TARGET = 0.4
REFERENCE_N = 100
MIN_RATE = 0.001
GAMMA = 2.0
BOOT_DRAWS, BOOT_ALPHA, BOOT_BLOCK, BOOT_SEED = 1000, 0.10, 2, 42


def tolerance(n: int) -> int:
    """Bars a pivot may come after its signal."""
    return min(n, max(30, round(0.3 * n)))


def greedy_matches(signals: Sequence[int], pivots: Sequence[int], cap: int, lead: int = LEAD_BARS) -> int:
    """Most pairs of a signal and a pivot in [signal - lead, signal + cap], each used once.

    All windows have one length, so the earliest free pivot is always a best choice.
    """
    n = i = 0
    for t in signals:
        while i < len(pivots) and pivots[i] < t - lead:
            i += 1
        if i < len(pivots) and pivots[i] <= t + cap:
            n, i = n + 1, i + 1
    return n


def match_stats(bars: DataFrame, keys: Sequence[str], side: str, n: int = REFERENCE_N, *, signal: str = "signal", label: str = "label", order: str = "bar") -> DataFrame:
    """(keys, n_signals, tp, fp, matched_pivots, total_pivots, n_bars, precision) of each slice.

    Only signals and pivots reach the fold; bars are counted beside it.
    """
    sign = 1 if side == "high" else -1
    cap = tolerance(n)
    is_signal, is_pivot = F.col(signal), F.col(label) == sign
    counts = bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), F.sum(is_signal.cast("long")).alias("n_signals"), F.sum(is_pivot.cast("long")).alias("total_pivots")
    )
    events = bars.where(is_signal | is_pivot).select(*keys, F.col(order).alias("__t"), is_signal.alias("__s"), is_pivot.alias("__p"))
    schema = bars.select(*keys).schema.add("tp", "long")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__t")
        t = table.column("__t").to_numpy()
        s, p = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("__s", "__p"))
        return table.select(list(keys)).slice(0, 1).append_column("tp", pa.array([greedy_matches(t[s].tolist(), t[p].tolist(), cap)], pa.int64()))

    matched = events.groupBy(*keys).applyInArrow(run, schema)
    joined = counts.join(matched, list(keys), "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return joined.select(
        *keys, "n_signals", "tp", (F.col("n_signals") - F.col("tp")).alias("fp"), F.col("tp").alias("matched_pivots"), "total_pivots", "n_bars",
        F.when(F.col("n_signals") > 0, F.col("tp") / F.col("n_signals")).otherwise(0.0).alias("precision"),
    )


def excess_penalty(signals: Column, pivots: Column) -> Column:
    n, t = F.greatest(signals.cast("double"), F.lit(1.0)), F.greatest(pivots.cast("double"), F.lit(1.0))
    return 2.0 * n * t / (n * n + t * t)


def score_column(n_signals: Column, tp: Column, matched: Column, total: Column, bars: Column, n: int = REFERENCE_N) -> Column:
    """Side score at one scale from (weighted) counts."""
    precision = tp / n_signals
    recall = F.when(total > 0, matched / F.when(total > 0, total)).otherwise(0.0)
    target = RECALL_TARGET * math.sqrt(REFERENCE_N / max(n, 1))
    saturated = F.when(precision > 0, 1.0 - F.exp(-recall / target)).otherwise(0.0)
    raw = F.when((precision > 0) & (total > 0), F.pow(precision, F.lit(PRECISION_EXPONENT)) * saturated).otherwise(0.0)
    frequency = F.least(F.lit(1.0), n_signals / bars / MIN_RATE)
    return F.when((n_signals > 0) & (bars > 0), raw * frequency * excess_penalty(n_signals, total)).otherwise(0.0)


def safe_score(n: int = REFERENCE_N, prefix: str = "") -> Column:
    """``score_column`` over the columns of ``match_stats``, safe where there is nothing."""
    c = {k: F.col(prefix + k).cast("double") for k in ("n_signals", "tp", "matched_pivots", "total_pivots", "n_bars")}
    none = (c["n_signals"] <= 0) | (c["n_bars"] <= 0)
    one = F.lit(1.0)
    value = score_column(F.when(none, one).otherwise(c["n_signals"]), c["tp"], c["matched_pivots"], c["total_pivots"], F.when(none, one).otherwise(c["n_bars"]), n)
    return F.when(none, 0.0).otherwise(value)


def valid_scales(n_bars: int, scales: Sequence[int]) -> list[int]:
    return [k for k in scales if n_bars >= 2 * k + 1]


def valid_scale_column(n_bars: Column, scales: Sequence[int]) -> Column:
    """``valid_scales`` of a column of lengths, as an array."""
    return F.filter(F.array(*map(F.lit, scales)), lambda k: n_bars >= 2 * k + 1)


def side_score(bars: DataFrame, keys: Sequence[str], side: str, labels: dict[int, str], *, signal: str = "signal") -> DataFrame:
    """Score of each slice over the scales of ``labels`` {scale: column}, weighted by the scale's logarithm.

    A scale counts where the slice holds 2n + 1 bars; the penalty for too many or too few
    signals is taken at the valid scale nearest to the reference.
    """
    parts = None
    for n, col in sorted(labels.items()):
        m = match_stats(bars, keys, side, n, signal=signal, label=col)
        recall = F.when(F.col("total_pivots") > 0, F.col("matched_pivots") / F.when(F.col("total_pivots") > 0, F.col("total_pivots"))).otherwise(0.0)
        target = RECALL_TARGET * math.sqrt(REFERENCE_N / n)
        scale = F.when((F.col("precision") > 0) & (F.col("total_pivots") > 0), F.pow("precision", F.lit(PRECISION_EXPONENT)) * (1.0 - F.exp(-recall / target))).otherwise(0.0)
        m = m.where(F.col("n_bars") >= 2 * n + 1).select(*keys, "n_bars", "n_signals", "total_pivots", scale.alias("scale"), F.lit(n).alias("n"), F.lit(math.log(n) / math.log(500)).alias("weight"))
        parts = m if parts is None else parts.unionByName(m)
    nearest = F.min_by("total_pivots", F.struct(F.abs(F.col("n") - REFERENCE_N), "n"))
    agg = parts.groupBy(*keys).agg(
        F.first("n_bars").alias("n_bars"), F.first("n_signals").alias("n_signals"), nearest.alias("ref_pivots"),
        (F.sum(F.col("scale") * F.col("weight")) / F.sum("weight")).alias("raw"),
    )
    frequency = F.least(F.lit(1.0), F.col("n_signals") / F.col("n_bars") / MIN_RATE)
    score = F.when(F.col("n_signals") > 0, F.col("raw") * frequency * excess_penalty(F.col("n_signals"), F.col("ref_pivots"))).otherwise(0.0)
    every = bars.groupBy(*keys).agg(F.sum(F.col(signal).cast("long")).alias("__n")).drop("__n")
    return every.join(agg.withColumn("score", score), list(keys), "left").select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"))


def gap_penalty(oos: Column, inside: Column) -> Column:
    """The outside score, less the more the inside score exceeds it."""
    return oos * F.exp(-GAMMA * F.greatest(F.lit(0.0), inside - oos))


def pooled_scores(stats: DataFrame, weights: DataFrame | None, by: Sequence[str], n: int = REFERENCE_N) -> DataFrame:
    """(by, is_score, oos_score, fold_score, oos_pivots) from statistics of (by, half, stream_id), weighted by stream.

    A stream without a weight weighs 1; the weights are a dimension of streams.
    """
    if weights is not None:
        stats = stats.join(weights, "stream_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        stats = stats.withColumn("weight", F.lit(1.0))
    fields = ("n_signals", "tp", "matched_pivots", "total_pivots", "n_bars")
    pooled = stats.groupBy(*by, "half").agg(*(F.sum(F.col(f) * F.col("weight")).alias(f) for f in fields)).withColumn("score", safe_score(n))
    inside = F.max(F.when(F.col("half") == "is", F.col("score")))
    outside = F.max(F.when(F.col("half") == "oos", F.col("score")))
    pivots = F.max(F.when(F.col("half") == "oos", F.col("total_pivots")))
    wide = pooled.groupBy(*by).agg(F.coalesce(inside, F.lit(0.0)).alias("is_score"), F.coalesce(outside, F.lit(0.0)).alias("oos_score"), F.coalesce(pivots, F.lit(0.0)).alias("oos_pivots"))
    return wide.withColumn("fold_score", gap_penalty(F.col("oos_score"), F.col("is_score")))


@functools.cache
def bootstrap_indices(n: int, draws: int = BOOT_DRAWS, block: int = BOOT_BLOCK, seed: int = BOOT_SEED) -> np.ndarray:
    """(draws, n) positions of a circular block bootstrap; they depend on n alone."""
    rng = np.random.default_rng(seed)
    blocks = math.ceil(n / block)
    rows = [((rng.integers(0, n, size=blocks)[:, None] + np.arange(block)) % n).reshape(-1)[:n] for _ in range(draws)]
    return np.array(rows)


def bootstrap_lcb(scores: DataFrame, by: Sequence[str], order: str = "fold", score: str = "fold_score") -> DataFrame:
    """(by, n_folds, mean_score, lcb, ucb): percentile bounds of the mean over fold scores in order, for any number of folds.

    One fold is its own bound.  A group is the folds of one candidate or stream, so it is small however many groups there are.
    """
    names = ["n_folds", "mean_score", "lcb", "ucb"]
    schema = StructType([scores.schema[k] for k in by] + [StructField("n_folds", LongType())] + [StructField(n, DoubleType()) for n in names[1:]])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        v = table.sort_by("__order").column("__score").to_numpy()
        low = high = mean = float(v.mean())
        if len(v) > 1:
            low, high = np.percentile(v[bootstrap_indices(len(v))].mean(axis=1), [100 * BOOT_ALPHA / 2, 100 - 100 * BOOT_ALPHA / 2])
        columns = [pa.array([k.as_py()], k.type) for k in key] if by else []
        return pa.Table.from_arrays([*columns, pa.array([len(v)], pa.int64()), *(pa.array([float(x)]) for x in (mean, low, high))], [*by, *names])

    rows = scores.select(*by, F.col(order).alias("__order"), F.col(score).cast("double").alias("__score"))
    return rows.groupBy(*by).applyInArrow(run, schema)


def components(n: int = REFERENCE_N) -> dict[str, Column]:
    """What a score is made of, from the columns of ``match_stats``: 0 where there is nothing."""
    c = {k: F.col(k).cast("double") for k in ("n_signals", "tp", "matched_pivots", "total_pivots", "n_bars")}
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    recall = share(c["matched_pivots"], c["total_pivots"])
    return {
        "precision": share(c["tp"], c["n_signals"]), "recall": recall, "saturated_recall": 1.0 - F.exp(-recall / (RECALL_TARGET * math.sqrt(REFERENCE_N / n))),
        "frequency": F.least(F.lit(1.0), share(c["n_signals"], c["n_bars"]) / MIN_RATE), "excess": excess_penalty(c["n_signals"], c["total_pivots"]),
    }


def component_means(stats: DataFrame, by: Sequence[str], n: int = REFERENCE_N) -> DataFrame:
    """(by, component, mean, n_folds): the mean of each component over the rows of ``match_stats``, one a fold."""
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("component"), v.alias("value")) for k, v in components(n).items())))
    return stats.select(*by, named.alias("x")).select(*by, "x.*").groupBy(*by, "component").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n_folds"))
