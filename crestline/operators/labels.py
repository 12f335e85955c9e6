"""Turning-point labels by centred windows; they look ahead and are for scoring only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.windows import Slice, extreme

# Scales whose labels must agree for a structural label.
NEST = (50, 100, 200)
REFERENCE = 100


def label_pivots(df: DataFrame, s: Slice, n: int, out: str = "label") -> DataFrame:
    """1 at a centred high, -1 at a centred low, else 0 (also where both hold).

    In a run of equal labels every other bar keeps its label, from the first on.
    """
    high, low = extreme(s, "high", n, True), extreme(s, "low", n, False)
    raw = F.when(high & ~low, 1).when(low & ~high, -1).otherwise(0).cast("byte")
    df = df.withColumn("__raw", raw)
    changed = (F.col("__raw") != F.coalesce(s.lag("__raw"), F.lit(99))).cast("int")
    df = df.withColumn("__start", F.when(changed == 1, F.col(s.order)))
    first = F.last("__start", ignorenulls=True).over(s.w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__first", first)
    keep = (F.col(s.order) - F.col("__first")) % 2 == 0
    return df.withColumn(out, F.when(keep, F.col("__raw")).otherwise(0).cast("byte")).drop("__raw", "__start", "__first")


def structural_pivots(df: DataFrame, s: Slice, nest: Sequence[int] = NEST, out: str = "label") -> DataFrame:
    """A label that all scales of the nest give; none in a slice too short for the largest."""
    names = [f"__label{n}" for n in nest]
    for n, name in zip(nest, names, strict=True):
        df = label_pivots(df, s, n, name)
    same: Column = F.lit(True)
    for name in names[1:]:
        same = same & (F.col(name) == F.col(names[0]))
    return df.withColumn(out, F.when(same, F.col(names[0])).otherwise(0).cast("byte")).drop(*names)


def add_labels(df: DataFrame, s: Slice, nest: Sequence[int] = NEST, out: str = "label") -> DataFrame:
    """Labels, unless the frame has them already (they may be of a longer stream)."""
    return df if out in df.columns else structural_pivots(df, s, nest, out)


def baseline_pivots(df: DataFrame, s: Slice, n: int = 20) -> DataFrame:
    """``baseline_high`` and ``baseline_low``: the price of a pivot n bars ago, on the bar where it is known."""
    df = df.withColumns({"__ph": F.when(extreme(s, "high", n, True), F.col("high")), "__pl": F.when(extreme(s, "low", n, False), F.col("low"))})
    return df.withColumns({"baseline_high": s.lag("__ph", n), "baseline_low": s.lag("__pl", n)}).drop("__ph", "__pl")
