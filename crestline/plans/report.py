"""Reports: parity with an export, pool diagnostics, Markdown, JSON and constants for a chart script."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .params import Params

PARITY_TOLERANCE = 1e-6


def read_raw(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A chart's raw export: names stripped and lower-cased; raises without ``time``."""
    return _with_time(spark.read.option("header", True).option("inferSchema", True).csv(path), str.lower)


def read_enriched(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """An export with a script's plots: names stripped, their case kept; raises without ``time``."""
    return _with_time(spark.read.option("header", True).option("inferSchema", True).csv(path), str)


def _with_time(df: DataFrame, case) -> DataFrame:
    df = df.toDF(*(case(c.strip()) for c in df.columns))
    if "time" not in df.columns:
        raise ValueError("missing column: time")
    return df


def enriched_of(files: DataFrame, ticker: str, timeframe: str) -> DataFrame:
    """The first by name of the files (path, name) that are enriched exports of a stream; no row if there is none."""
    pattern = f"^{re.escape(ticker)}_{re.escape(timeframe)}_.*_TV_.*\\.csv$"
    return files.where(F.col("name").rlike(pattern)).orderBy("name").limit(1)


def parity_of_exports(spark: SparkSession, raw: str, enriched: str, columns: Sequence[str]) -> DataFrame:
    """``parity`` of two files: ``columns`` that both hold under any case, and the enriched one's signals."""
    return parity(read_raw(spark, raw), export_signals(read_enriched(spark, enriched)), columns)


def export_signals(df: DataFrame) -> DataFrame:
    """Signals of an enriched export: a strong or a regular mark above zero."""
    def mark(side: str) -> Column:
        return (F.coalesce(F.col(f"strong {side}"), F.lit(0)) + F.coalesce(F.col(f"regular {side}"), F.lit(0))) > 0

    df = df.toDF(*(c.strip().lower() for c in df.columns))
    return df.withColumns({"signal_high": mark("high"), "signal_low": mark("low")})


def parity(ours: DataFrame, theirs: DataFrame, columns: Sequence[str], on: Sequence[str] = ("time",)) -> DataFrame:
    """(column, n_compared, n_mismatch, rate, max_abs_diff) of columns that both frames have, joined on time.

    Booleans differ when unequal, numbers beyond a tolerance; rows with a NULL on a side are not compared.
    """
    a = ours.select(*on, *(F.col(c).cast("double").alias(f"{c}_a") for c in columns))
    b = theirs.select(*on, *(F.col(c).cast("double").alias(f"{c}_b") for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b")) for c in columns))
    long = a.join(b, list(on)).select(F.explode(pairs).alias("x")).select("x.*")
    diff = F.abs(F.col("a") - F.col("b"))
    agg = long.groupBy("column").agg(F.count(diff).alias("n_compared"), F.sum((diff > PARITY_TOLERANCE).cast("long")).alias("n_mismatch"), F.max(diff).alias("max_abs_diff"))
    n, bad = F.col("n_compared"), F.coalesce("n_mismatch", F.lit(0))
    return agg.select("column", "n_compared", bad.alias("n_mismatch"), F.when(n > 0, bad / F.when(n > 0, n)).otherwise(0.0).alias("rate"), F.coalesce("max_abs_diff", F.lit(0.0)).alias("max_abs_diff"))


def pool_diagnostic(slices: DataFrame, label: str = "label") -> DataFrame:
    """(side, n_folds, informative, mean_pivots) of the outside halves."""
    per_fold = slices.where("half = 'oos'").groupBy("fold").agg(F.sum((F.col(label) == 1).cast("long")).alias("high"), F.sum((F.col(label) == -1).cast("long")).alias("low"))
    long = per_fold.select(F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("n")) for s in ("high", "low")))).alias("x")).select("x.*")
    return long.groupBy("side").agg(F.count(F.lit(1)).alias("n_folds"), F.sum((F.col("n") > 0).cast("long")).alias("informative"), F.avg("n").alias("mean_pivots"))


def constant(value: object) -> str:
    """A value as a chart script writes it."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.4f}"
    return f'"{value}"' if isinstance(value, str) else str(value)


def chart_constants(params: Params, name: str) -> str:
    lines = [f"// {name}"]
    for side in ("high", "low"):
        lines += [f"{k}_{side} = {constant(v)}" for k, v in asdict(params.side(side)).items()]
    return "\n".join([*lines, f"baseline_lb = {params.baseline_lb}"])


def constant_rows(spark: SparkSession, params: Params) -> DataFrame:
    return spark.createDataFrame([(k, constant(v)) for k, v in params.to_dict().items()], "name string, value string")


def markdown_table(df: DataFrame, digits: int = 4, most: int = 200) -> str:
    """A small frame as a table; ``most`` rows reach the driver, and a last line says how many are left out."""
    rows = df.limit(most + 1).collect()
    left = df.count() - most if len(rows) > most else 0
    rows = rows[:most]
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    body = ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]
    more = ["", f"{left} more rows"] if left else []
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *body, *more])


def render_report(title: str, sections: dict[str, DataFrame | str]) -> str:
    out = [f"# {title}"]
    for name, part in sections.items():
        out += ["", f"## {name}", "", part if isinstance(part, str) else markdown_table(part)]
    return "\n".join(out) + "\n"


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def provenance(spark: SparkSession, folder: str, bars: DataFrame, run: dict) -> str:
    """A run as JSON, with each stream's bars and dates and each file's digest."""
    files = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file"), F.substring(F.sha2("content", 256), 1, 12).alias("sha256"))
    spans = bars.groupBy("stream_id").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"))
    return json.dumps(run | {"files": [r.asDict() for r in files.orderBy("file").collect()], "streams": [r.asDict() for r in spans.orderBy("stream_id").collect()]}, indent=2, default=str)
