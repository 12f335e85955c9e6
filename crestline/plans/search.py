"""A search that samples: candidates are asked for in batches, scored on all folds in one job, pruned, told and resumed.

After ``startup`` uniform draws each parameter is drawn near those of the better trials:
of a few such draws the one is taken that is likeliest among the better trials against
the others (Parzen windows over ranks of the range).  Trials asked for in one batch that
have no score yet count as poor ones, so a batch spreads.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import optimize, pipeline
from .params import SideParams, active_thresholds, space_for

BETTER, TRIES = 0.2, 24


@dataclass
class Study:
    """One side's trials in a table that the driver alone appends to; a second run goes on where the first ended."""

    spark: SparkSession
    path: str
    name: str
    side: str
    base: SideParams
    startup: int = 20
    prune_startup: int = 20
    prune_warmup: int = 2
    seed: int = 0

    def trials(self) -> DataFrame:
        return optimize.read_trials(self.spark, self.path, self.name)

    def _told(self) -> list[tuple[int, str, float | None, dict]]:
        """All trials so far: the search's own, so as many as were asked for."""
        try:
            rows = self.trials().orderBy("trial").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []  # nothing was told yet
            raise
        return [(r["trial"], r["state"], r["score"], json.loads(r["params"])) for r in rows]

    def bounds(self) -> dict[str, tuple[float, float]]:
        space = space_for(self.side).floats
        return {k: space[k] for k in active_thresholds(self.base)}

    def ask(self, n: int) -> list[tuple[int, SideParams]]:
        """The next ``n`` trials; their draws depend on the seed, the trials told so far and their numbers alone."""
        told = self._told()
        scored = sorted(((s, i) for i, (_, state, s, _) in enumerate(told) if state == "COMPLETE" and s is not None), reverse=True)
        good = [told[i][3] for _, i in scored[: max(1, round(BETTER * len(scored)))]]
        poor = [told[i][3] for _, i in scored[len(good) :]] + [p for _, state, _, p in told if state != "COMPLETE"]
        first, out = max((t[0] for t in told), default=-1) + 1, []
        for trial in range(first, first + n):
            rng = random.Random(f"{self.seed}/{self.name}/{trial}")
            values = {k: rng.uniform(*b) for k, b in self.bounds().items()}
            if len(scored) >= self.startup:
                values = {k: self._drawn(rng, b, [p[k] for p in good], [p[k] for p in poor]) for k, b in self.bounds().items()}
            poor.append(values)
            out.append((trial, replace(self.base, **values)))
        return out

    @staticmethod
    def _drawn(rng: random.Random, bounds: tuple[float, float], good: Sequence[float], poor: Sequence[float]) -> float:
        lo, hi = bounds
        width = max((hi - lo) / (1 + len(good)), 1e-9)

        def density(x: float, at: Sequence[float]) -> float:
            return (1 + sum(math.exp(-(((x - a) / width) ** 2) / 2) for a in at)) / (1 + len(at))

        tries = [min(hi, max(lo, rng.gauss(rng.choice(good), width))) for _ in range(TRIES)]
        return max(tries, key=lambda x: (density(x, good) / density(x, poor), -x))

    def tell(self, rows: Sequence[tuple[int, str, float | None, SideParams]]) -> None:
        keys = list(self.bounds())
        optimize.append_trials(self.spark, self.path, self.name, [(t, state, s, {k: getattr(p, k) for k in keys}) for t, state, s, p in rows])

    def step(self, score: optimize.PooledScorer, n: int) -> None:
        """Asks, scores and tells one batch; a candidate whose running bound falls under the batch's median is pruned."""
        asked = self.ask(n)
        found: dict[int, tuple[str, float]] = {}
        for folds in score.folds([p for _, p in asked]):
            bounds = pipeline.running_bounds(folds).persist()
            pruned = {r["candidate"] for r in pipeline.median_pruned(bounds, self.prune_startup, self.prune_warmup).where("pruned").collect()}
            last: dict[int, tuple[int, float]] = {}
            for r in bounds.collect():
                last[r["candidate"]] = max(last.get(r["candidate"], (-1, 0.0)), (r["upto"], r["lcb"]))
            bounds.unpersist()
            found |= {c: ("PRUNED" if c in pruned else "COMPLETE", s) for c, (_, s) in last.items()}
        self.tell([(t, *found.get(i, ("COMPLETE", 0.0)), p) for i, (t, p) in enumerate(asked)])

    def run(self, score: optimize.PooledScorer, trials: int, batch: int = 8) -> SideParams:
        """Steps until so many trials are told, those of earlier runs included; the best one's thresholds."""
        while (left := trials - len(self._told())) > 0:
            self.step(score, min(batch, left))
        return self.best()

    def best(self) -> SideParams:
        done = [(s, -t, p) for t, state, s, p in self._told() if state == "COMPLETE" and s is not None]
        return replace(self.base, **max(done, key=lambda x: x[:2])[2]) if done else self.base


def warm_start(spark: SparkSession, path: str, side: str, base: SideParams) -> SideParams:
    """``base`` with the side's values of a JSON file that holds one trial, or one trial a side."""
    from .params import Params, params_from_trial

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one trial
    trial = json.loads(text)
    return params_from_trial(trial.get(side, trial), side, Params().with_side(side, **vars(base))).side(side)
