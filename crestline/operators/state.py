"""Detector state: duration at an extreme, pivot drift and cooldown."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.windows import Slice, is_true


def duration(df: DataFrame, s: Slice, hit: Column, out: str) -> DataFrame:
    """Hits since the last two misses in a row; one miss alone is forgiven."""
    df = df.withColumn("__hit", is_true(hit))
    reset = (~F.col("__hit") & ~F.coalesce(s.lag("__hit"), F.lit(True))).cast("int")
    df = df.withColumn("__reset", reset)
    df = df.withColumn("__island", F.sum("__reset").over(s.w.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*s.keys, "__island").orderBy(s.order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.col("__hit").cast("int")).over(w)).drop("__hit", "__reset", "__island")


def pivot_drift(df: DataFrame, s: Slice, lookbacks: dict[str, int]) -> DataFrame:
    """For each {column: m}: relative change a step over the last max(m, 2) confirmed pivots before the bar.

    Highs and lows are one list, a bar's high before its low; the bar's own pivots
    come after it.  0 while there are too few.  Needs ``baseline_high`` and ``baseline_low``.
    """
    most = max([2, *lookbacks.values()])
    events = F.filter(F.array(F.col("baseline_high").cast("double"), F.col("baseline_low").cast("double")), lambda v: v.isNotNull())
    df = df.withColumn("__events", events)
    # bars with pivots carry the last few of the list; the others look back to the nearest
    marks = df.where(F.size("__events") > 0).select(*s.keys, F.col(s.order).alias("__at"), "__events")
    we = Window.partitionBy(*s.keys).orderBy("__at").rowsBetween(-(most - 1), 0)
    marks = marks.withColumn("__tail", F.flatten(F.collect_list("__events").over(we))).select(*s.keys, "__at", F.slice("__tail", -F.least(F.size("__tail"), F.lit(most)), F.lit(most)).alias("__tail"))
    joined = df.join(marks.withColumnRenamed("__at", s.order), [*s.keys, s.order], "left")
    before = F.last("__tail", ignorenulls=True).over(s.w.rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("__stack", before)

    def drift(m: int) -> Column:
        m = max(m, 2)
        start, end = F.try_element_at("__stack", F.lit(-m)), F.try_element_at("__stack", F.lit(-1))
        slope = (end - start) / F.greatest(F.abs(start), F.lit(1e-9)) / float(m - 1)
        return F.when(F.size("__stack") >= m, slope).otherwise(0.0)

    return joined.withColumns({out: drift(m) for out, m in lookbacks.items()}).drop("__events", "__tail", "__stack")


def accepted(positions: list[int], bars: int) -> list[int]:
    """Indices of the positions that are accepted: the first, then each more than ``bars`` after the last accepted."""
    last, keep = None, []
    for i, t in enumerate(positions):
        if last is None or t - last > bars:
            last = t
            keep.append(i)
    return keep


def cooled(df: DataFrame, s: Slice, candidate: str, bars: int) -> DataFrame:
    """(keys, bar) of the candidates that are accepted; only candidates leave the JVM."""
    order = s.order

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        return table.take(pa.array(accepted(table.column(order).to_pylist(), bars), pa.int64()))

    rows = df.where(F.col(candidate)).select(*s.keys, order)
    return rows.groupBy(*s.keys).applyInArrow(run, rows.schema)


def mark_signals(df: DataFrame, s: Slice, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """All rows with each {signal: (candidate, cooldown)} in place of its candidate, in one pass over a slice."""
    kept, order = [c for c in df.columns if c not in {x for x, _ in wanted.values()} | set(wanted)], s.order
    schema = df.select(*kept).schema
    for out in wanted:
        schema = schema.add(out, "boolean")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        at = table.column(order).to_numpy()
        out = table.select(kept)
        for name, (candidate, bars) in wanted.items():
            hits = np.flatnonzero(table.column(candidate).to_numpy(zero_copy_only=False).astype(bool))
            flags = np.zeros(len(at), bool)
            flags[hits[accepted(at[hits].tolist(), bars)]] = True
            out = out.append_column(name, pa.array(flags))
        return out

    return df.groupBy(*s.keys).applyInArrow(run, schema)
