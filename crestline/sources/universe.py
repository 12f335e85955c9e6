"""Streams by file name, their clusters and their catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Time frames and what they are called, groups, and tickers that move together.
TIMEFRAMES = ("1m", "5", "15", "30", "60", "120", "240", "1D", "1W", "1M")
SPELLINGS = {"1": "1m", "D": "1D", "W": "1W", "M": "1M"}


GROUPS = {
    "INDICES": ("SPX", "NDX", "DAX"),
    "STOCKS": (
        "AAPL", "ABBV", "AMD", "AMZN", "AVGO", "BAC", "BRKB", "COST", "CSCO", "CVX", "GE", "GOOG", "GOOGL", "HD", "JNJ",
        "JPM", "KO", "LLY", "MA", "MCD", "META", "MSFT", "NFLX", "ORCL", "PG", "PLTR", "TMUS", "TSLA", "V", "XOM",
    ),
    "FX": ("EURGBP", "EURJPY", "EURUSD", "GBPUSD", "USDCHF", "USDRUB", "USDSEK"),
    "COMMODITIES": ("GC1", "SI1", "PL1", "PA1", "WTI"),
    "WORLD_ETF": ("VT", "VWCE"),
}
POOL_FRAMES = ("1D", "240", "60")
#: A cluster is a group's tickers, or those of a list; all other tickers are clusters of their own.
CLUSTER_OF_GROUP = {"STOCKS": "US_EQ", "FX": "FX", "WORLD_ETF": "WORLD_EQ"}
CLUSTER_LISTS = {"US_EQ": ("SPX", "NDX"), "EU_EQ": ("DAX",), "METALS": ("GC1", "SI1", "PL1", "PA1"), "ENERGY": ("WTI",)}


def clusters() -> dict[str, str]:
    """Each ticker's cluster."""
    out = {t: c for g, c in CLUSTER_OF_GROUP.items() for t in GROUPS[g]}
    return out | {t: c for c, tickers in CLUSTER_LISTS.items() for t in tickers}


def tickers_of(groups: Sequence[str], universe: dict[str, Sequence[str]] | None = None) -> list[str]:
    """Tickers of the groups in order, each once; a group that does not exist has none."""
    known = GROUPS if universe is None else universe
    return list(dict.fromkeys(t for g in groups for t in known.get(g, ())))


def resolve_groups(files: DataFrame, groups: Sequence[str], frames: Sequence[str] = POOL_FRAMES, universe: dict[str, Sequence[str]] | None = None, cluster_map: dict[str, str] | None = None) -> DataFrame:
    """``resolve_streams`` of all tickers of some groups; pairs without a file are left out."""
    return resolve_streams(files, tickers_of(groups, universe), frames, clusters() if cluster_map is None else cluster_map)


def timeframe(raw: Column) -> Column:
    out = raw
    for spelt, name in SPELLINGS.items():
        out = F.when(raw == spelt, name).otherwise(out)
    return F.when(out.isin(*TIMEFRAMES), out)


def parse_export_name(name: Column) -> tuple[Column, Column]:
    """(ticker, time frame) of ``{PREFIX}, {TF}_{hash}.csv``; NULL where it is not one."""
    pattern = r"^(.+), ([0-9A-Za-z]+)_[^,]*\.csv$"
    frame = timeframe(F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")))
    ticker = F.translate(F.substring_index(F.regexp_extract(name, pattern, 1), "_", -1), "!.", "")
    return F.when(frame.isNotNull(), ticker), frame


def parse_canonical_name(name: Column) -> tuple[Column, Column]:
    """(ticker, time frame) of ``{TICKER}_{TF}_{rest}.csv``."""
    parts = F.split(F.regexp_replace(name, r"\.csv$", ""), "_")
    frame = F.when((F.size(parts) >= 3) & name.endswith(".csv") & ~F.contains(name, F.lit(", ")), timeframe(F.try_element_at(parts, F.lit(2))))
    return F.when(frame.isNotNull(), parts[0]), frame


def parse_names(files: DataFrame, name: str = "name") -> DataFrame:
    """``files`` with ticker and timeframe from either form of name."""
    e, c = parse_export_name(F.col(name)), parse_canonical_name(F.col(name))
    return files.withColumns({"ticker": F.coalesce(e[0], c[0]), "timeframe": F.coalesce(e[1], c[1])})


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name) of a folder's CSV files, by a listing alone: contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    return files.withColumn("name", F.url_decode(F.substring_index("path", "/", -1)))


def resolve_streams(files: DataFrame, tickers: Sequence[str], frames: Sequence[str], clusters: dict[str, str] | None = None) -> DataFrame:
    """(ticker, timeframe, path, cluster_id, stream_id): the first file by name of each wanted pair; a ticker is its own cluster by default."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(t, i) for i, t in enumerate(dict.fromkeys(tickers))], "ticker string, t int").crossJoin(
        spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(frames))], "timeframe string, f int")
    )
    first = Window.partitionBy("ticker", "timeframe").orderBy("name")
    known = parse_names(files).where("ticker IS NOT NULL").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    joined = known.join(F.broadcast(wanted), ["ticker", "timeframe"])
    groups = spark.createDataFrame(list((clusters or {}).items()) or [("", "")], "ticker string, cluster string")
    joined = joined.join(F.broadcast(groups), "ticker", "left")
    return joined.orderBy("t", "f").select("ticker", "timeframe", "path", F.coalesce("cluster", "ticker").alias("cluster_id"), F.concat_ws("_", "ticker", "timeframe").alias("stream_id"))


def cluster_weights(streams: DataFrame) -> DataFrame:
    """(stream_id, weight): one by the number of the pool's streams in its cluster."""
    sizes = streams.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return streams.join(sizes, "cluster_id").select("stream_id", (F.lit(1.0) / F.col("n")).alias("weight"))


def catalogue(bars: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """(keys, bars, first, last, duplicates) of each stream."""
    per_time = bars.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("n"))
    return per_time.groupBy(*keys).agg(F.sum("n").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum((F.col("n") > 1).cast("long")).alias("duplicates"))


def cross_timeframe_gate(base_precision: float, other_precision: float, most_drop: float = 0.15) -> dict:
    """Whether precision holds on another time frame."""
    drop = base_precision - other_precision
    return {"base_precision": base_precision, "other_precision": other_precision, "drop": drop, "holds": drop <= most_drop}
