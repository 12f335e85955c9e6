"""Whole runs: one stream on walk-forward folds, a pool on calendar folds, and several instruments.

    python -m crestline.plans.pipeline --bars DIR --out DIR [--preset default] [--sweeps 1] [--grid 5]
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.windows import Slice
from ..operators import labels as L
from ..operators.detector import detect
from ..operators.scoring import REFERENCE_N, bootstrap_lcb, component_means, gap_penalty, match_stats, safe_score, side_score
from ..sources import bars as B, universe as U
from . import folds, optimize, report
from .params import PRESETS, SIDES, Params


@dataclass(frozen=True)
class RunConfig:
    """``label_whole``: labels are of the whole stream; else of each slice alone."""

    preset: str = "default"
    nest: tuple[int, ...] = L.NEST
    n: int = REFERENCE_N
    volume_policy: str = "mixed"
    label_whole: bool = True
    sweeps: int = 1
    grid_n: int = 5


def walk_forward_scores(bars: DataFrame, params: Params, config: RunConfig = RunConfig()) -> DataFrame:
    """(stream_id, side, fold, is_score, oos_score, gap, fold_score) of every stream on its own folds.

    Each half is a slice with a warm-up of its own; scales count where both halves have room.
    """
    whole = L.add_labels(bars, Slice(), config.nest) if config.label_whole else bars.drop("label")
    slices = folds.cut_slices(whole, folds.walk_forward_table(bars))
    s = Slice(("stream_id", "fold", "half"))
    marked = detect(L.add_labels(slices, s, config.nest), s, params)
    out = None
    for side in SIDES:
        stats = match_stats(marked.withColumnRenamed(f"signal_{side}", "signal"), s.keys, side, config.n).withColumn("score", safe_score(config.n))
        least = F.min("n_bars").over(Window.partitionBy("stream_id", "fold"))
        stats = stats.withColumn("score", F.when(least >= 2 * config.n + 1, F.col("score")).otherwise(0.0))
        of = lambda half: F.coalesce(F.max(F.when(F.col("half") == half, F.col("score"))), F.lit(0.0))
        wide = stats.groupBy("stream_id", "fold").agg(of("is").alias("is_score"), of("oos").alias("oos_score"))
        gap = F.greatest(F.lit(0.0), F.col("is_score") - F.col("oos_score"))
        part = wide.select("stream_id", F.lit(side).alias("side"), "fold", "is_score", "oos_score", gap.alias("gap"), gap_penalty(F.col("oos_score"), F.col("is_score")).alias("fold_score"))
        out = part if out is None else out.unionByName(part)
    return out


def run_table(scores: DataFrame) -> DataFrame:
    """(stream_id, side, n_folds, mean_score, lcb, ucb) over the folds of each stream and side."""
    return bootstrap_lcb(scores, ["stream_id", "side"])


def holdout_table(bars: DataFrame, params: Params, config: RunConfig = RunConfig()) -> DataFrame:
    """(stream_id, part, side, score) before and in the holdout."""
    s = Slice(("stream_id", "part"))
    split = folds.holdout_split(L.add_labels(bars, Slice(), config.nest))
    w = Window.partitionBy(*s.keys).orderBy("ts")
    marked = detect(split.withColumn("bar", (F.row_number().over(w) - 1).cast("long")), s, params)
    parts = [
        side_score(marked.withColumnRenamed(f"signal_{x}", "signal"), s.keys, x, {config.n: "label"}).withColumn("side", F.lit(x)) for x in SIDES
    ]
    return parts[0].unionByName(parts[1]).select("stream_id", "part", "side", "score")


def running_bounds(scores: DataFrame) -> DataFrame:
    """(candidate, upto, lcb): the lower bound after each informative fold, for pruning."""
    w = Window.partitionBy("candidate").orderBy("fold")
    placed = scores.where("oos_pivots > 0").withColumn("at", F.row_number().over(w))
    placed = placed.withColumn("__last", F.max("at").over(Window.partitionBy("candidate")))
    prefixes = placed.withColumn("upto", F.explode(F.sequence("at", "__last")))
    return bootstrap_lcb(prefixes, ["candidate", "upto"]).select("candidate", "upto", "lcb")


def median_pruned(bounds: DataFrame, startup: int = 20, warmup: int = 2) -> DataFrame:
    """(candidate, pruned): whether a bound after the warm-up is under the median of the candidates at that fold."""
    medians = bounds.groupBy("upto").agg(F.median("lcb").alias("m"), F.count(F.lit(1)).alias("n"))
    low = (F.col("upto") > warmup) & (F.col("n") > startup) & (F.col("lcb") < F.col("m"))
    return bounds.join(F.broadcast(medians), "upto").groupBy("candidate").agg(F.max(low).alias("pruned"))


def score_instruments(spark: SparkSession, paths: dict[str, str], params: Params, config: RunConfig = RunConfig(), fmt: str = "csv") -> DataFrame:
    """(instrument, side, score, error): the whole of each file; a file that cannot be read has an error row."""
    rows, found = [], None
    for name, path in paths.items():
        try:
            b = B.read_bars(spark, path, fmt, stream=F.lit(name))
            found = b if found is None else found.unionByName(b)
        except (AnalysisException, ValueError) as e:  # no such file, or not the columns of bars
            rows += [(name, side, None, type(e).__name__) for side in SIDES]
    out = spark.createDataFrame(rows, "instrument string, side string, score double, error string")
    if found is not None:
        marked = detect(L.add_labels(found, Slice(), config.nest), Slice(), params)
        for x in SIDES:
            scored = side_score(marked.withColumnRenamed(f"signal_{x}", "signal"), ["stream_id"], x, {config.n: "label"})
            out = out.unionByName(scored.select(F.col("stream_id").alias("instrument"), F.lit(x).alias("side"), "score", F.lit(None).cast("string").alias("error")))
    return out


def fold_components(bars: DataFrame, params: Params, config: RunConfig = RunConfig()) -> DataFrame:
    """(side, component, mean, n_folds) over the outside halves of all streams' folds."""
    whole = L.add_labels(bars, Slice(), config.nest) if config.label_whole else bars.drop("label")
    slices = folds.cut_slices(whole, folds.walk_forward_table(bars)).where("half = 'oos'")
    s = Slice(("stream_id", "fold", "half"))
    marked = detect(L.add_labels(slices, s, config.nest), s, params)
    parts = [component_means(match_stats(marked.withColumnRenamed(f"signal_{x}", "signal"), s.keys, x, config.n).withColumn("side", F.lit(x)), ["side"], config.n) for x in SIDES]
    return parts[0].unionByName(parts[1])


def scale_transfer(bars: DataFrame, params: Params, side: str, *, unit: str = "week", most_drop: float = 0.15, config: RunConfig = RunConfig()) -> DataFrame:
    """(stream_id, base_precision, other_precision, drop, holds): whether a side's precision holds on a longer time frame."""
    frames = {"base": bars, "other": B.resample(bars, unit=unit)}
    parts = None
    for name, frame in frames.items():
        marked = detect(L.add_labels(frame.drop("label"), Slice(), config.nest), Slice(), params, (side,)).withColumnRenamed(f"signal_{side}", "signal")
        stats = match_stats(marked, ["stream_id"], side, config.n).select("stream_id", F.col("precision").alias(f"{name}_precision"))
        parts = stats if parts is None else parts.join(stats, "stream_id", "left")
    fall = F.col("base_precision") - F.coalesce("other_precision", F.lit(0.0))
    return parts.select("stream_id", "base_precision", F.coalesce("other_precision", F.lit(0.0)).alias("other_precision"), fall.alias("drop"), (fall <= most_drop).alias("holds"))


def hits_near(events: DataFrame, known: DataFrame, days: int = 30) -> DataFrame:
    """``known(ts)`` with ``hit``: an event lies within so many days.

    Both sides meet in blocks of ``days``: an event near a date is in its block or the one to either side.
    """
    block = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / max(days, 1))
    d = known.select(F.col("ts").alias("known_ts")).distinct().withColumn("__block", F.explode(F.array(*(block("known_ts") + F.lit(i) for i in (-1, 0, 1)))))
    e = events.select("ts", block("ts").alias("__block")).distinct()
    near = e.join(d, "__block").where(F.abs(F.datediff(F.col("ts"), F.col("known_ts"))) <= days).select("known_ts").distinct().withColumn("hit", F.lit(True))
    return known.join(near, known["ts"] == near["known_ts"], "left").select("ts", F.coalesce("hit", F.lit(False)).alias("hit"))


def run_pool(bars: DataFrame, weights: DataFrame | None, config: RunConfig = RunConfig(), plan: folds.CalendarPlan | None = None) -> dict:
    """Ascent over thresholds of both sides on calendar folds: {side: AscentResult}, winners scored once more from bars."""
    plan = plan or folds.CalendarPlan(nest=config.nest)
    params = PRESETS[config.preset]
    kept = B.apply_volume_policy(bars, config.volume_policy)
    slices = folds.calendar_slices(L.add_labels(kept, Slice(), config.nest), folds.calendar_folds(kept, plan), plan).persist()
    out = {}
    for side in SIDES:
        score = optimize.pooled_scorer(slices, params, side, weights, config.n)
        found = optimize.ascend(params.side(side), side, score, sweeps=config.sweeps, grid_n=config.grid_n)
        again = optimize.pooled_scorer(slices, params.with_side(side, **vars(found.params)), side, weights, config.n)
        found.score = again([found.params])[0]
        again.close()
        score.close()
        out[side] = found
    slices.unpersist()
    return out


def progress(trials: DataFrame) -> DataFrame:
    """Trials so far of each study."""
    return optimize.study_summary(trials)


def watch(spark: SparkSession, path: str, attempts: int = 5, wait: float = 2.0) -> list[dict]:
    """``progress`` of a table that another run appends to; a read that meets a half-written file is tried again."""
    for left in reversed(range(attempts)):
        try:
            return [r.asDict() for r in progress(optimize.read_trials(spark, path)).orderBy("study").collect()]
        except (AnalysisException, PySparkException, Py4JError):
            if not left:
                raise
            time.sleep(wait)
    return []


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--bars", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--preset", default="default", choices=sorted(PRESETS))
    p.add_argument("--sweeps", type=int, default=1)
    p.add_argument("--grid", type=int, default=5)
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = RunConfig(preset=a.preset, sweeps=a.sweeps, grid_n=a.grid)
    files = U.parse_names(U.list_files(spark, a.bars)).where("ticker IS NOT NULL")
    name = F.url_decode(F.substring_index(F.input_file_name(), "/", -1))
    bars = B.read_bars(spark, [r["path"] for r in files.select("path").collect()], stream=name)
    params = PRESETS[a.preset]
    scores = walk_forward_scores(bars, params, config)
    found = run_pool(bars, None, config)
    sections = {"Catalogue": U.catalogue(bars), "Walk-forward": run_table(scores), "Holdout": holdout_table(bars, params, config)}
    sections |= {f"Ascent, {side}": optimize.trace_frame(spark, r) for side, r in found.items()}
    report.write_text(spark, f"{a.out}/report.md", report.render_report("Run", sections))
    run = {"preset": a.preset, "scores": {k: r.score for k, r in found.items()}, "params": {k: vars(r.params) for k, r in found.items()}}
    report.write_text(spark, f"{a.out}/run.json", report.provenance(spark, a.bars, bars, run))


if __name__ == "__main__":
    main()
