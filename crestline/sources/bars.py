"""Bar streams: files of prices and volumes, bars made from ticks, resampling, and volume quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

REQUIRED = ("open", "high", "low", "close", "volume")
# Volumes that stand for "no data", and the least that is real.
PLACEHOLDERS = (0, 2400, 3596, 3597, 3598, 3599, 3600, 3601)
LEAST_REAL = 100_000
FULL_BELOW, NONE_ABOVE, ONSET_BARS = 0.05, 0.95, 60
POLICIES = ("price_only", "mixed", "volume_required")


def normalise_headers(df: DataFrame) -> DataFrame:
    """Stripped, lower-case names; raises where a price or volume column is missing."""
    df = df.toDF(*(c.strip().lower() for c in df.columns))
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_bars(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv", stream: Column | None = None) -> DataFrame:
    """Bars (stream_id, ts, bar, open, high, low, close, volume) of one or many files.

    CSV headers are matched without case, and ``time`` holds Unix seconds.  A stream is a
    file, unless ``stream`` names it.  Rows of one stream are numbered in the order of time.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("header", True).csv(paths) if fmt == "csv" else spark.read.format(fmt).load(paths)
    df = normalise_headers(raw.withColumn("stream_id__", F.coalesce(stream, F.input_file_name()) if stream is not None else F.input_file_name()))
    ts = F.timestamp_seconds(F.col("time").cast("long")) if "time" in df.columns else F.lit(None).cast("timestamp")
    df = df.select(F.col("stream_id__").alias("stream_id"), ts.alias("ts"), *(F.col(c).cast("double").alias(c) for c in REQUIRED))
    return number_bars(df)


def number_bars(df: DataFrame, keys: Sequence[str] = ("stream_id",), order: str = "ts", out: str = "bar") -> DataFrame:
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def to_bars(ticks: DataFrame, price: str, volume: Column, *, keys: Sequence[str] = ("stream_id",), ts: str = "ts", tie: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """Open, high, low, close and volume of each unit of time; ``tie`` orders ticks of one moment.

    Open and close are the prices at the least and the greatest (time, tie): plain
    aggregates, which combine before the shuffle, so no key's ticks are sorted.
    """
    at = F.struct(ts, *tie)
    return ticks.groupBy(*keys, F.date_trunc(unit, ts).alias("ts")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume")
    )


def resample(bars: DataFrame, *, keys: Sequence[str] = ("stream_id",), unit: str = "day") -> DataFrame:
    """Bars of a longer unit; units without a close or without volume are left out."""
    out = bars.groupBy(*keys, F.date_trunc(unit, "ts").alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return number_bars(out.where(F.col("close").isNotNull() & (F.col("volume") > 0)), keys)


def is_placeholder(volume: str = "volume") -> Column:
    v = F.coalesce(F.col(volume), F.lit(0))
    return v.isin(*PLACEHOLDERS) | (v < LEAST_REAL)


def volume_profile(bars: DataFrame, *, keys: Sequence[str] = ("stream_id",), order: str = "bar") -> DataFrame:
    """(keys, quality, real_from, placeholder_share): full, partial or none.

    A partial stream is real from the first bar on whose next ``ONSET_BARS`` bars hold few placeholders.
    """
    p = is_placeholder().cast("double")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, ONSET_BARS - 1)
    ahead = bars.select(*keys, "ts", p.alias("p"), F.avg(p).over(w).alias("ahead"))
    agg = ahead.groupBy(*keys).agg(F.avg("p").alias("placeholder_share"), F.min("ts").alias("__start"), F.min(F.when(F.col("ahead") < FULL_BELOW, F.col("ts"))).alias("__onset"))
    share = F.col("placeholder_share")
    quality = F.when(share < FULL_BELOW, "full").when(share > NONE_ABOVE, "none").otherwise("partial")
    real_from = F.when(share < FULL_BELOW, F.col("__start")).when(share > NONE_ABOVE, F.lit(None)).otherwise(F.col("__onset"))
    return agg.select(*keys, quality.alias("quality"), real_from.cast("timestamp").alias("real_from"), "placeholder_share")


def apply_volume_policy(bars: DataFrame, policy: str, *, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Bars that a policy keeps: all, or (``volume_required``) those from the first real volume on."""
    if policy not in POLICIES:
        raise ValueError(f"unknown volume policy {policy!r}")
    if policy != "volume_required":
        return bars
    real = volume_profile(bars, keys=keys).where("quality <> 'none' AND real_from IS NOT NULL").select(*keys, "real_from")
    joined = bars.join(real, list(keys)).where(F.col("ts") >= F.col("real_from"))
    first = Window.partitionBy(*keys)
    at = F.min(F.when(F.col("volume") >= LEAST_REAL, F.col("ts"))).over(first)
    return number_bars(joined.withColumn("__from", at).where(F.col("ts") >= F.col("__from")).drop("__from", "real_from"), keys)


def order_ticks(spark: SparkSession, sf_dir: str, walk: bool = True) -> DataFrame:
    """Ticks (stream_id, ts, key, px in cents) from orders; ``walk``: the running sum of each stream, a random walk."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = o.select(F.col("o_orderpriority").alias("stream_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("long").alias("px"))
    if not walk:
        return t
    w = Window.partitionBy("stream_id").orderBy("ts", "key").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("__sum", F.sum(F.col("px") - 25_000_000).over(w)).withColumn("px", F.lit(500_000_000) + F.expr("__sum div 5")).drop("__sum")


def order_bars(spark: SparkSession, sf_dir: str, walk: bool = True) -> DataFrame:
    """Daily bars of the order streams, in cents."""
    bars = to_bars(order_ticks(spark, sf_dir, walk), "px", F.lit(100_000), tie=("key",))
    return number_bars(bars).select("stream_id", "ts", "bar", *REQUIRED)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events, in cents."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = e.select(F.lit("events").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("key"), F.round(F.col("value") * 100).cast("long").alias("px"))
    return number_bars(to_bars(t, "px", F.lit(1), tie=("key",), unit="hour")).select("stream_id", "ts", "bar", *REQUIRED)
