"""Bars and alerts of unbounded streams, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, *, late: str = "2 days", unit: str = "1 day") -> DataFrame:
    """Bars of ticks (stream_id, ts, key, px): a unit is emitted when the watermark has passed it."""
    at = F.struct("ts", "key")
    w = F.window("ts", unit)
    agg = ticks.withWatermark("ts", late).groupBy("stream_id", w).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return agg.select("stream_id", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


ALERTS = "stream_id string, bar long, ts timestamp, side string, price double"
_STATE = "n long, highs array<double>, lows array<double>, times array<timestamp>, was_high boolean, was_low boolean"


def confirm_pivots(bars: DataFrame, n: int = 20) -> DataFrame:
    """Alerts (stream_id, bar, ts, side, price) when a bar is known to be the extreme of the n bars on either side.

    The alert is on the rising edge, n bars late, as ``baseline_pivots`` knows it.  State is
    the last 2n+1 bars of a stream, so it does not grow; bars must come in order within a stream.
    """
    size = 2 * n + 1

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, highs, lows, times, was_high, was_low = state.get if state.exists else (0, [], [], [], False, False)
        highs, lows, times = list(highs), list(lows), list(times)
        out = []
        for r in pd.concat(list(frames)).sort_values("ts").itertuples():
            highs, lows, times = [*highs, float(r.high)][-size:], [*lows, float(r.low)][-size:], [*times, r.ts][-size:]
            seen += 1
            is_high = len(highs) == size and highs[n] == max(highs)
            is_low = len(lows) == size and lows[n] == min(lows)
            for now, before, side, price in ((is_high, was_high, "high", highs), (is_low, was_low, "low", lows)):
                if now and not before:
                    out.append((key[0], seen - 1 - n, times[n], side, price[n]))
            was_high, was_low = is_high, is_low
        state.update((seen, highs, lows, [pd.Timestamp(t).to_pydatetime() for t in times], was_high, was_low))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "bar", "ts", "side", "price"])

    return bars.groupBy("stream_id").applyInPandasWithState(run, ALERTS, _STATE, "append", GroupStateTimeout.NoTimeout)
