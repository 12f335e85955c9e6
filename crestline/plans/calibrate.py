"""Exact and cross-validated cut-points of a feature against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BETA = 0.5
GRID = 256
#: Ranges of values that running sums go over one by one.
RANGES = 64


def objective(tp: Column, predicted: Column, positives: Column, total: Column, kind: str = "fbeta", beta: float = BETA) -> Column:
    """F-beta, or true less false positive rate; 0 where undefined."""
    if kind == "youden":
        negatives = total - positives
        tpr = F.when(positives > 0, tp / F.when(positives > 0, positives)).otherwise(0.0)
        fpr = F.when(negatives > 0, (predicted - tp) / F.when(negatives > 0, negatives)).otherwise(0.0)
        return tpr - fpr
    if kind != "fbeta":
        raise ValueError(f"unknown objective {kind!r}")
    down = predicted + beta * beta * positives  # (1+b2) tp / (tp + fp + b2 (tp + fn))
    return F.when(down > 0, (1 + beta * beta) * tp / F.when(down > 0, down)).otherwise(0.0)


def cutpoint_curve(rows: DataFrame, feature: str, positive: str, *, keys: Sequence[str] = (), kind: str = "fbeta", leq: bool = False) -> DataFrame:
    """(keys, threshold, score, precision, recall, n_predicted) of every value as a cut.

    Rows are first counted by value, so the running sums go over distinct values.
    """
    value = F.col(feature).cast("double")
    y = F.coalesce(F.col(positive), F.lit(False))
    counted = rows.groupBy(*keys, value.alias("__v")).agg(F.sum(y.cast("long")).alias("__tp"), F.count(F.lit(1)).alias("__n"))
    # ranges of values are summed apart, then each starts where the one before it ends
    known = F.col("__v").isNotNull() & ~F.isnan("__v")
    shares = [F.lit(i / RANGES) for i in range(1, RANGES)]
    found = rows.select(value.alias("__v")).where(known).agg(F.percentile_approx("__v", F.array(*shares)).alias("e")).first()["e"] if shares else None
    edges = sorted(set(found or []))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("__v"))) if edges else F.lit(0)
    counted = counted.withColumn("__range", F.when(known, at))
    ranges = counted.groupBy(*keys, "__range").agg(F.sum("__tp").alias("__rtp"), F.sum("__n").alias("__rn"))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # of no more than RANGES rows a key
    before = every.orderBy(F.col("__range").asc_nulls_last() if leq else F.col("__range").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        *keys, "__range", F.coalesce(F.sum("__rtp").over(before), F.lit(0)).alias("__tp0"), F.coalesce(F.sum("__rn").over(before), F.lit(0)).alias("__n0"),
        F.sum("__rtp").over(every).alias("positives"), F.sum("__rn").over(every).alias("total"),
    ).where("__range IS NOT NULL")
    w = Window.partitionBy(*keys, "__range").orderBy(F.col("__v").asc() if leq else F.col("__v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # a missing feature is never predicted, but it counts
    own = counted.where(known).select(*keys, "__range", "__v", F.sum("__tp").over(w).alias("__t"), F.sum("__n").over(w).alias("__c"))
    out = own.join(starts, [*keys, "__range"]).select(*keys, "__v", (F.col("__t") + F.col("__tp0")).alias("tp"), (F.col("__c") + F.col("__n0")).alias("n_predicted"), "positives", "total")
    d = {k: F.col(k).cast("double") for k in ("tp", "n_predicted", "positives", "total")}
    return out.select(
        *keys, F.col("__v").alias("threshold"), objective(d["tp"], d["n_predicted"], d["positives"], d["total"], kind).alias("score"),
        (d["tp"] / d["n_predicted"]).alias("precision"), F.when(d["positives"] > 0, d["tp"] / F.when(d["positives"] > 0, d["positives"])).otherwise(0.0).alias("recall"), "n_predicted",
    )


def best_cutpoint(rows: DataFrame, feature: str, positive: str, *, keys: Sequence[str] = (), kind: str = "fbeta", leq: bool = False, min_predicted: int = 1) -> DataFrame:
    """The cut with the best score; of equals, the one that predicts most."""
    curve = cutpoint_curve(rows, feature, positive, keys=keys, kind=kind, leq=leq).where(F.col("n_predicted") >= min_predicted)
    best = F.max_by(F.struct(*(c for c in curve.columns if c not in keys)), F.struct("score", "n_predicted"))
    return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def cv_cutpoint(rows: DataFrame, feature: str, positive: str, *, keys: Sequence[str] = (), n_rows: int | None = None, folds: int = 5, embargo: int = 10, order: str = "bar", kind: str = "fbeta") -> DataFrame:
    """(keys, threshold, score): of a grid of quantiles, the cut with the best mean out-of-fold score; the lowest of equals.

    ``order`` numbers the rows of each key from 0 on; without ``n_rows`` the blocks divide all of them.
    ``embargo`` takes rows from training parts, which cuts of a fixed grid do not use.
    Each test block is counted by grid cell, and sums from the cell on give all cuts at once.
    """
    by = list(keys) or ["__all"]
    rows = rows.select(*(keys or [F.lit(0).alias("__all")]), F.col(order).alias("__at"), F.col(feature).cast("double").alias("v"), F.col(positive).cast("long").alias("__y"))
    qs = [i / (GRID - 1) for i in range(GRID)]
    n = F.max("__at") + 1 if n_rows is None else F.lit(n_rows)
    # one row a key: its size and its grid
    grid = rows.groupBy(*by).agg(n.cast("long").alias("__n"), F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).where("q IS NOT NULL")
    cuts = grid.select(*by, F.explode(F.array_distinct("q")).alias("threshold"))
    edge = [F.floor(F.col("__n") * i / F.lit(folds)) for i in range(1, folds)]
    block = sum(((F.col("__at") >= e).cast("int") for e in edge), F.lit(0))
    tests = rows.join(grid, by).where((F.col("__at") >= 0) & (F.col("__at") < F.col("__n")))
    # the cell of a value: the largest cut that is not above it
    cell = F.array_max(F.filter("q", lambda t: t <= F.col("v")))
    cells = tests.select(*by, block.alias("block"), cell.alias("threshold"), "__y").groupBy(*by, "block", "threshold").agg(F.sum("__y").alias("tp"), F.count(F.lit(1)).alias("n"))
    blocks = cells.groupBy(*by, "block").agg(F.sum("tp").alias("positives"), F.sum("n").alias("total")).where("positives > 0")
    full = blocks.join(cuts, by).join(cells, [*by, "block", "threshold"], "left")
    w = Window.partitionBy(*by, "block").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    sums = full.select(*by, "block", "threshold", F.sum(F.coalesce("tp", F.lit(0))).over(w).cast("double").alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(w).cast("double").alias("n"), F.col("positives").cast("double"), F.col("total").cast("double"))
    scored = sums.select(*by, "threshold", objective(F.col("tp"), F.col("n"), F.col("positives"), F.col("total"), kind).alias("s"))
    mean = scored.groupBy(*by, "threshold").agg(F.avg("s").alias("score"))
    best = F.max_by(F.struct("threshold", "score"), F.struct(F.round("score", 12), -F.col("threshold"))).alias("b")
    return mean.groupBy(*by).agg(best).select(*keys, "b.*")
