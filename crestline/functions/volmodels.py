"""Volatility models: HAR over Garman-Klass variance in columns, GJR asymmetry by a fold per slice."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .windows import Slice, clip, floor_at

# Weights, decay and floors of the two models.
HAR_WEIGHTS = (0.36, 0.28, 0.28)
HAR_SPANS = (5, 22)
GJR_ALPHA, GJR_GAMMA, GJR_BETA = 0.03, 0.08, 0.90
GJR_LONG_RUN = 252


def har_norm(df: DataFrame, s: Slice, out: str = "har_norm") -> DataFrame:
    """Forecast by present volatility, less 1, in halves, in [-1, 1]; longer means are the present one in warm-up."""
    high_low = floor_at(F.ln(F.col("high") / F.col("low")), 1e-10)
    close_open = F.ln(F.col("close") / F.col("open"))
    gk = floor_at(0.5 * high_low * high_low - (2 * math.log(2) - 1) * close_open * close_open, 1e-10)
    df = df.withColumn("__gk", gk)
    week, month = (F.coalesce(s.full(n, F.avg, "__gk"), F.col("__gk")) for n in HAR_SPANS)
    now, w, m = HAR_WEIGHTS
    df = df.withColumns({"__w": week, "__m": month})
    ratio = F.sqrt(now * F.col("__gk") + w * F.col("__w") + m * F.col("__m")) / F.sqrt("__gk")
    return df.withColumn(out, clip((ratio - 1) / 0.5, -1.0, 1.0)).drop("__gk", "__w", "__m")


def gjr_fold(r: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Asymmetry of the two variance recursions, bar by bar."""
    g = s = max(float(r[0]) ** 2, 1e-12) if len(r) else 0.0
    out = np.empty(len(r))
    for t in range(len(r)):
        if t:
            q, negative = r[t - 1] ** 2, r[t - 1] < 0
            g = omega[t] + (GJR_ALPHA + GJR_GAMMA * negative) * q + GJR_BETA * g
            s = omega[t] + (GJR_ALPHA + GJR_GAMMA / 2) * q + GJR_BETA * s
        out[t] = min(1.0, max(-1.0, (g / s - 1) / 0.1))
    return out


def gjr_norm(df: DataFrame, sl: Slice, out: str = "gjr_norm") -> DataFrame:
    """Column ``out`` with the normalised asymmetry.

    Returns and long-run variance are window columns; the recursion itself, which no
    window expresses, is one pass over a slice's two arrays.
    """
    r = F.coalesce(F.ln(F.col("close") / sl.lag("close")), F.lit(0.0))
    df = df.withColumn("__r", r).withColumn("__r2", F.col("__r") * F.col("__r"))
    share = 1 - GJR_ALPHA - GJR_BETA - GJR_GAMMA / 2
    long_run = sl.full(GJR_LONG_RUN, F.avg, "__r2")
    omega = F.when(long_run.isNotNull(), F.greatest(F.greatest(long_run, F.lit(1e-12)) * share, F.lit(1e-12)))
    df = df.withColumn("__omega", F.coalesce(omega, F.greatest(F.col("__r2"), F.lit(1e-12)))).drop("__r2")
    kept, order = [c for c in df.columns if c not in ("__r", "__omega", out)], sl.order

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        norm = gjr_fold(table.column("__r").to_numpy(), table.column("__omega").to_numpy())
        return table.select(kept).append_column(out, pa.array(norm, pa.float64()))

    return df.groupBy(*sl.keys).applyInArrow(run, df.select(*kept).schema.add(out, "double"))
