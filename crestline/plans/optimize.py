"""Parameter search: coordinate ascent over thresholds, stability probes, and the table of trials."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import evaluate
from .params import Params, SideParams, active_thresholds, draws, space_for

IMPROVEMENT = 1e-6


def grid(lo: float, hi: float, n: int, now: float) -> list[float]:
    """Evenly spaced values of a range, and the present one."""
    step = (hi - lo) / (n - 1) if n > 1 else 0.0
    return sorted({round(lo + step * i, 12) for i in range(n)} | {now})


def planned_evaluations(sweeps: int, n_fields: int, grid_n: int) -> int:
    return 1 + sweeps * n_fields * max(1, grid_n - 1)


@dataclass
class AscentResult:
    params: SideParams
    score: float
    trace: list[dict] = field(default_factory=list)


def ascend(start: SideParams, side: str, score: Callable[[Sequence[SideParams]], list[float]], *, sweeps: int = 2, grid_n: int = 5, fields: Sequence[str] | None = None) -> AscentResult:
    """Cyclic coordinate ascent; ``score`` is given all values of one axis at once.

    A move needs a strict improvement, so the score never falls; a sweep without one ends it.
    """
    best, now = start, score([start])[0]
    trace = [{"step": 0, "sweep": 0, "field": "", "value": math.nan, "score": now, "accepted": True}]
    space = space_for(side)
    for sweep in range(1, sweeps + 1):
        before = now
        for name in fields or active_thresholds(best):
            values = [v for v in grid(*space.floats[name], grid_n, getattr(best, name)) if v != getattr(best, name)]
            tried = [replace(best, **{name: v}) for v in values]
            for v, p, s in zip(values, tried, score(tried) if tried else [], strict=True):
                better = s > now + IMPROVEMENT
                trace.append({"step": len(trace), "sweep": sweep, "field": name, "value": v, "score": s, "accepted": better})
                if better:
                    best, now = p, s
        if now <= before + IMPROVEMENT:
            break
    return AscentResult(best, now, trace)


class PooledScorer:
    """Scores sets of thresholds by the lower bound over folds.

    Features that depend on lookbacks are kept across calls; an extreme percentile changes
    agreement, so each distinct one has a feature table of its own, of which the last
    ``MOST_TABLES`` used are kept.  ``close`` releases them.
    """

    MOST_TABLES = 4

    def __init__(self, slices: DataFrame, params: Params, side: str, weights: DataFrame | None, n: int = 100):
        self.params, self.side, self.weights, self.n = params, side, weights, n
        self.live = slices.join(evaluate.informative_folds(slices, side), "fold", "left_semi")
        self.kept: dict[float, DataFrame] = {}

    def _table(self, p: SideParams) -> DataFrame:
        key = round(p.pct_extreme, 12)
        table = self.kept.pop(key, None)
        if table is None:
            table = evaluate.features(self.live, replace(self.params, **{self.side: p}), self.side).persist()
        self.kept[key] = table  # the last used comes last
        while len(self.kept) > self.MOST_TABLES:
            self.kept.pop(next(iter(self.kept))).unpersist()
        return table

    def folds(self, candidates: Sequence[SideParams]) -> Iterator[DataFrame]:
        """(candidate, fold, ..., fold_score) of all candidates, a frame for each extreme percentile."""
        for p in candidates:
            evaluate.check_shape(self.params.side(self.side), p)
        by_pct: dict[float, list[tuple[int, SideParams]]] = {}
        for i, p in enumerate(candidates):
            by_pct.setdefault(round(p.pct_extreme, 12), []).append((i, p))
        for group in by_pct.values():
            yield evaluate.score_candidates(self._table(group[0][1]), self.side, group, self.weights, self.n)

    def __call__(self, candidates: Sequence[SideParams]) -> list[float]:
        out = [0.0] * len(candidates)
        for folds in self.folds(candidates):
            for r in evaluate.objective(folds).collect():
                out[r["candidate"]] = float(r["lcb"])
        return out

    def close(self) -> None:
        for table in self.kept.values():
            table.unpersist()
        self.kept.clear()


def pooled_scorer(slices: DataFrame, params: Params, side: str, weights: DataFrame | None, n: int = 100) -> PooledScorer:
    return PooledScorer(slices, params, side, weights, n)


def trace_frame(spark: SparkSession, result: AscentResult) -> DataFrame:
    return spark.createDataFrame([tuple(t.values()) for t in result.trace], "step int, sweep int, field string, value double, score double, accepted boolean")


TRIALS = "study string, trial long, state string, score double, params string"


def read_trials(spark: SparkSession, path: str, study: str | None = None) -> DataFrame:
    """The trials of a table, each once: a trial that was written again (by a run that was resumed) counts as its complete one, then its best."""
    rows = spark.read.schema(TRIALS).parquet(path)
    rows = rows.where(F.col("study") == study) if study is not None else rows
    newest = F.max_by(F.struct("state", "score", "params"), F.struct((F.col("state") == "COMPLETE").cast("int"), F.coalesce("score", F.lit(float("-inf"))), "params"))
    return rows.groupBy("study", "trial").agg(newest.alias("x")).select("study", "trial", "x.*")


def append_trials(spark: SparkSession, path: str, study: str, rows: Sequence[tuple[int, str, float | None, dict]]) -> None:
    """Adds finished trials to a study's table; the driver alone writes."""
    spark.createDataFrame([(study, i, state, score, json.dumps(p, sort_keys=True)) for i, state, score, p in rows], TRIALS).write.mode("append").parquet(path)


def study_summary(trials: DataFrame, top: int = 50) -> DataFrame:
    """(study, n_trials, n_complete, n_pruned, best_trial, best, p75, deflated) of each study.

    The best score is deflated by the spread of the top scores times what the best of n draws gains by chance.
    """
    done = trials.where("state = 'COMPLETE'")
    ranked = done.withColumn("rank", F.row_number().over(Window.partitionBy("study").orderBy(F.desc("score"), "trial")))
    complete = ranked.groupBy("study").agg(
        F.count(F.lit(1)).alias("n_complete"), F.max("score").alias("best"), F.min(F.when(F.col("rank") == 1, F.col("trial"))).alias("best_trial"),
        F.percentile("score", F.lit(0.75)).alias("p75"), F.stddev_pop(F.when(F.col("rank") <= top, F.col("score"))).alias("spread"),
    )
    n = F.col("n_complete").cast("double")
    deflated = F.col("best") - F.col("spread") * F.sqrt(2.0 * F.ln(n) / n)
    counts = trials.groupBy("study").agg(F.count(F.lit(1)).alias("n_trials"), F.sum((F.col("state") == "PRUNED").cast("long")).alias("n_pruned"))
    joined = counts.join(complete, "study", "left")
    return joined.select("study", "n_trials", F.coalesce("n_complete", F.lit(0)).alias("n_complete"), "n_pruned", "best_trial", "best", "p75", deflated.alias("deflated"))


def stability(samples: DataFrame, best: float) -> DataFrame:
    """(kind, n, mean, p75, std, near_share, ratio, verdict) of scores of draws near and far."""
    near = F.avg((F.col("score") >= 0.9 * best).cast("double"))
    agg = samples.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.percentile("score", F.lit(0.75)).alias("p75"), F.stddev_pop("score").alias("std"), near.alias("near_share"))
    ratio = F.lit(0.0) if best == 0 else F.col("mean") / best
    verdict = F.when((F.col("near_share") >= 0.2) & (F.col("ratio") >= 0.6), "stable").when((F.col("near_share") >= 0.08) & (F.col("ratio") >= 0.35), "moderate").otherwise("outlier")
    return agg.withColumn("ratio", ratio).withColumn("verdict", verdict)


def probe(spark: SparkSession, side: str, at: SideParams, score: Callable[[Sequence[SideParams]], list[float]], n_local: int = 50, n_global: int = 50, seed: int = 42) -> DataFrame:
    """(kind, score) of draws near ``at`` and over the whole space."""
    drawn = list(draws(side, at, n_local, n_global, seed))
    scores = score([replace(at, **values) for _, values in drawn])
    return spark.createDataFrame([(kind, s) for (kind, _), s in zip(drawn, scores, strict=True)], "kind string, score double")


def sensitivity(trials: DataFrame, names: Sequence[str], top: int | None = None) -> DataFrame:
    """(name, r): correlation of each parameter with the score, strongest first; the ``top`` ones if asked."""
    wide = trials.agg(*(F.corr(n, "score").alias(n) for n in names))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("r")) for n in names))).alias("x")).select("x.*")
    ordered = long.orderBy(F.desc(F.abs("r")), "name")
    return ordered if top is None else ordered.limit(top)


def parameter_map(trials: DataFrame, names: Sequence[str]) -> DataFrame:
    """Trials in the plane of the first two principal components of their z-scores."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=list(names), outputCol="__v").transform(trials)
    z = StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True).fit(v).transform(v)
    from pyspark.ml.functions import vector_to_array

    out = PCA(k=2, inputCol="__z", outputCol="__p").fit(z).transform(z).withColumn("__a", vector_to_array("__p"))
    return out.withColumns({"pc1": F.col("__a")[0], "pc2": F.col("__a")[1]}).drop("__v", "__z", "__p", "__a")
