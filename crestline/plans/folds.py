"""Validation schemes: holdout, walk-forward and calendar folds, purged blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Shares of a stream and least sizes.
HOLDOUT, INSIDE, OUTSIDE, STEP = 0.20, 0.10, 0.03, 0.05
LEAST_HOLDOUT, LEAST_INSIDE, LEAST_OUTSIDE, LEAST_STEP = 63, 252, 63, 63
EMBARGO = 20


@dataclass(frozen=True)
class ValidationScheme:
    n_bars: int
    holdout: int
    inside: int
    outside: int
    step: int
    embargo: int = EMBARGO

    @property
    def active(self) -> int:
        return self.n_bars - self.holdout


def infer_scheme(n: int, embargo: int = EMBARGO) -> ValidationScheme:
    scheme = ValidationScheme(n, max(LEAST_HOLDOUT, round(HOLDOUT * n)), max(LEAST_INSIDE, round(INSIDE * n)), max(LEAST_OUTSIDE, round(OUTSIDE * n)), max(LEAST_STEP, round(STEP * n)), embargo)
    if n <= LEAST_INSIDE + embargo + LEAST_OUTSIDE or scheme.inside + embargo + scheme.outside > scheme.active:
        raise ValueError(f"{n} bars are too few for one fold")
    return scheme


def fold_rows(s: ValidationScheme) -> list[tuple[int, int, int, int, int]]:
    """(fold, first inside bar, its end, first outside bar, its end) of each walk-forward fold."""
    out, at = [], 0
    while at + s.inside + s.embargo + s.outside <= s.active:
        a = at + s.inside
        out.append((len(out), at, a, a + s.embargo, a + s.embargo + s.outside))
        at += s.step
    return out


def describe_scheme(s: ValidationScheme) -> dict:
    return asdict(s) | {"mode": "rolling_bars_sliding", "n_folds": len(fold_rows(s))}


def walk_forward_table(bars: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """(keys, fold, is_start, is_end, oos_start, oos_end) of every stream that is long enough, in bars.

    Sizes come from each stream's count alone, so no bar reaches the driver.
    """
    n = F.col("n_bars")

    def share(x: float, least: int):
        return F.greatest(F.bround(n * F.lit(x), 0).cast("long"), F.lit(least))

    sizes = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars")).select(
        *keys, "n_bars", share(HOLDOUT, LEAST_HOLDOUT).alias("holdout"), share(INSIDE, LEAST_INSIDE).alias("inside"),
        share(OUTSIDE, LEAST_OUTSIDE).alias("outside"), share(STEP, LEAST_STEP).alias("step"),
    )
    room = n - F.col("holdout") - F.col("inside") - F.lit(EMBARGO) - F.col("outside")
    starts = sizes.withColumn("__room", room).where((n > LEAST_INSIDE + EMBARGO + LEAST_OUTSIDE) & (F.col("__room") >= 0))
    each = starts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__room") / F.col("step")))).alias("fold"))
    a = F.col("fold") * F.col("step")
    b = a + F.col("inside")
    return each.select(*keys, "fold", a.alias("is_start"), b.alias("is_end"), (b + EMBARGO).alias("oos_start"), (b + EMBARGO + F.col("outside")).alias("oos_end"))


def holdout_split(bars: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Bars with ``part``: inside, or outside for the last of each stream."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    hold = F.greatest(F.bround(n * F.lit(HOLDOUT), 0).cast("long"), F.lit(LEAST_HOLDOUT))
    return bars.withColumn("part", F.when(F.col("bar") < n - hold, "is").otherwise("oos"))


def prefix(bars: DataFrame, n: int) -> DataFrame:
    """The first bars of each stream; they are numbered from 0 on."""
    return bars.where(F.col("bar") < n)


def tail(bars: DataFrame, n: int, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """The last bars of each stream."""
    return bars.withColumn("__last", F.max("bar").over(Window.partitionBy(*keys))).where(F.col("bar") > F.col("__last") - n).drop("__last")


def cut_slices(bars: DataFrame, folds: DataFrame, keys: Sequence[str] = ("stream_id",), order: str = "bar") -> DataFrame:
    """Bars of each (fold, half), numbered anew, by a join of the bars with the few folds of their stream."""
    halves = folds.select(*keys, "fold", F.explode(F.array(F.struct(F.lit("is").alias("half"), F.col("is_start").alias("lo"), F.col("is_end").alias("hi")), F.struct(F.lit("oos").alias("half"), F.col("oos_start").alias("lo"), F.col("oos_end").alias("hi")))).alias("h")).select(*keys, "fold", "h.*")
    # folds grow with the streams, so the join is left to be planned by their size
    joined = bars.join(halves, list(keys)).where((F.col(order) >= F.col("lo")) & (F.col(order) < F.col("hi")))
    return joined.withColumn("bar", F.col("bar") - F.col("lo")).drop("lo", "hi") if order == "bar" else joined.drop("lo", "hi")


@dataclass(frozen=True)
class CalendarPlan:
    """Folds of a pool: gate and embargo follow from the largest scale of the labels' nest."""

    nest: tuple[int, ...] = (50, 100, 200)
    inside: float = INSIDE
    outside: float = OUTSIDE
    step: float = STEP
    holdout: float = HOLDOUT
    coverage: float = 0.5
    min_streams: int | None = None
    start: str | None = None

    @property
    def gate(self) -> int:
        return 2 * max(self.nest) + 1

    @property
    def embargo(self) -> int:
        return max(self.nest)


def calendar_folds(bars: DataFrame, plan: CalendarPlan = CalendarPlan(), stream: str = "stream_id") -> DataFrame:
    """(fold, is_start, is_end, oos_start, oos_end) as times of the reference stream.

    Only each stream's first and last time and its number of bars in the common era
    reach the driver (one row a stream); the edges are looked up in the reference.
    """
    spark = bars.sparkSession
    spans = bars.groupBy(stream).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy(stream).collect()
    empty = spark.createDataFrame([], "fold int, is_start timestamp, is_end timestamp, oos_start timestamp, oos_end timestamp")
    if not spans:
        return empty
    starts, ends = sorted(r["lo"] for r in spans), sorted((r["hi"] for r in spans), reverse=True)
    if plan.start is not None:
        lo, hi = F.lit(plan.start).cast("timestamp"), None
    else:
        k = min(plan.min_streams if plan.min_streams is not None else max(2, round(plan.coverage * len(spans))), len(spans))
        lo, hi = F.lit(starts[k - 1]), F.lit(ends[k - 1])
    found = _era_folds(bars, plan, stream, lo, hi)
    if not found and plan.start is None and starts[k - 1] > starts[0]:
        found = _era_folds(bars, plan, stream, F.lit(starts[0]), None)
    return spark.createDataFrame(found, empty.schema) if found else empty


def _era_folds(bars: DataFrame, plan: CalendarPlan, stream: str, lo, hi) -> list[tuple]:
    era = bars.where((F.col("ts") >= lo) & (F.col("ts") <= hi) if hi is not None else F.col("ts") >= lo)
    # the stream with most bars, the first by name among equals
    best = era.groupBy(stream).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), stream).first()
    if best is None:
        return []
    n = best["n"]
    inside, outside = max(plan.gate, round(n * plan.inside)), max(plan.gate, round(n * plan.outside))
    step, active = max(1, round(n * plan.step)), n - round(n * plan.holdout)
    rows, at = [], 0
    while at + inside + plan.embargo + outside <= active:
        rows.append((at, at + inside, at + inside + plan.embargo, at + inside + plan.embargo + outside))
        at += step
    wanted = sorted({x for r in rows for x in r})
    ref = era.where(F.col(stream) == best[stream]).select("ts", (F.row_number().over(Window.partitionBy(stream).orderBy("ts")) - 1).alias("at"))
    times = {r["at"]: r["ts"] for r in ref.where(F.col("at").isin(wanted)).collect()} if wanted else {}
    return [(i, *(times[x] for x in r)) for i, r in enumerate(rows)]


def calendar_slices(bars: DataFrame, folds: DataFrame, plan: CalendarPlan = CalendarPlan(), stream: str = "stream_id") -> DataFrame:
    """Bars of each (fold, half, stream), numbered anew; a stream that is short in a half is left out of the fold."""
    half = F.explode(F.array(F.struct(F.lit("is").alias("half"), F.col("is_start").alias("lo"), F.col("is_end").alias("hi")), F.struct(F.lit("oos").alias("half"), F.col("oos_start").alias("lo"), F.col("oos_end").alias("hi"))))
    edges = folds.select("fold", half.alias("h")).select("fold", "h.*")
    cut = bars.drop("bar").join(F.broadcast(edges), (F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi"))).drop("lo", "hi")
    w = Window.partitionBy("fold", stream, "half")
    cut = cut.withColumns({"bar": (F.row_number().over(w.orderBy("ts")) - 1).cast("long"), "__n": F.count(F.lit(1)).over(w)})
    both = F.size(F.collect_set("half").over(Window.partitionBy("fold", stream)))
    return cut.where(F.col("__n") >= plan.gate).withColumn("__both", both).where("__both = 2").drop("__n", "__both")


def purged_blocks(spark: SparkSession, n: int, k: int, embargo: int) -> DataFrame:
    """(block, test_start, test_end, before, after): train on bars under ``before`` and from ``after`` on."""
    edges = [int(n * i / k) for i in range(k + 1)]
    rows = [(i, edges[i], edges[i + 1], max(0, edges[i] - embargo), min(n, edges[i + 1] + embargo)) for i in range(k)]
    return spark.createDataFrame(rows, "block int, test_start long, test_end long, before long, after long")


def purged_parts(rows: DataFrame, blocks: DataFrame, order: str = "bar") -> DataFrame:
    """Every row for each block, as test or train; rows in an embargo are left out."""
    at = F.col(order)
    joined = rows.crossJoin(F.broadcast(blocks))  # as many copies as blocks: a parameter
    test = (at >= F.col("test_start")) & (at < F.col("test_end"))
    train = (at < F.col("before")) | (at >= F.col("after"))
    return joined.withColumn("part", F.when(test, "test").when(train, "train")).where("part IS NOT NULL").drop("test_start", "test_end", "before", "after")
