"""Searches that sample, trials that are read and resumed, bounds over many folds, and scores by both ways."""

import json
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions.windows import Slice
from crestline.operators import agreement, labels, scoring
from crestline.operators.detector import detect
from crestline.plans import evaluate, folds, optimize, pipeline, report, search
from crestline.plans.params import PRESETS
from crestline.queries import engine
from crestline.sources import bars as B, universe as U
from crestline.sources.scratch import shared_path

DATA = "/root/testdata/sf0.001"
S = Slice()


@pytest.mark.parametrize("n", [1, 2, 3, 21, 65, 200])
def test_bounds_of_any_number_of_folds(spark, n):
    rng = random.Random(n)
    v = [round(rng.random(), 6) for _ in range(n)]
    rows = [("a", i, x) for i, x in enumerate(v)] + [("b", 0, 0.5), ("b", 1, 0.1)]
    random.Random(1).shuffle(rows)
    got = {r["k"]: r for r in scoring.bootstrap_lcb(spark.createDataFrame(rows, "k string, fold int, fold_score double"), ["k"]).collect()}
    draws = [np.array(v)[idx].mean() for idx in scoring.bootstrap_indices(n)] if n > 1 else [v[0]]
    low, high = np.percentile(draws, [5, 95])
    r = got["a"]
    assert (r["n_folds"], r["mean_score"], r["lcb"], r["ucb"]) == (n, pytest.approx(np.mean(v)), pytest.approx(low), pytest.approx(high))
    assert got["b"]["n_folds"] == 2
    whole = scoring.bootstrap_lcb(spark.createDataFrame(rows, "k string, fold int, fold_score double").where("k = 'a'"), [])
    assert whole.first()["lcb"] == pytest.approx(low)


def test_agreement_recovers_from_missing_closes(spark):
    rng = np.random.default_rng(0)
    close = np.cumsum(rng.normal(size=400)) + 100
    rows = [("a", i, None if i in (50, 51, 200) else float(x)) for i, x in enumerate(close)]
    df = spark.createDataFrame(rows, "stream_id string, bar long, close double")
    sides = {"hi": (True, 0.8), "lo": (False, 0.8)}
    ways = []
    for method in ("windows", "arrays"):
        got = agreement.agreement(df, S, [3, 6, 9], sides, method).orderBy("bar").collect()
        ways.append([(r["bar"], round(r["hi"], 9), round(r["lo"], 9)) for r in got])
    assert ways[0] == ways[1]
    assert any(h + low > 0 for b, h, low in ways[0] if 90 < b < 190) and any(h + low > 0 for b, h, low in ways[0] if b > 240)
    values = np.array([np.nan if r[2] is None else r[2] for r in rows])
    m = agreement.position_matrix(values, [3], np.float64)[0]
    for t in range(400):
        rel = [values[i] / values[i - 2 : i + 1].mean() if i >= 2 else np.nan for i in range(t - 19, t + 1)] if t >= 21 else [np.nan]
        expect = np.nan if np.isnan(rel).any() else (rel[-1] - min(rel)) / max(max(rel) - min(rel), 1e-10)
        assert (np.isnan(m[t]) and np.isnan(expect)) or m[t] == pytest.approx(expect)


class Stub:
    """Fold scores that are best at one place; folds get worse for poor candidates."""

    def __init__(self, spark):
        self.spark, self.seen = spark, []

    def folds(self, candidates):
        rows = []
        for i, p in enumerate(candidates):
            self.seen.append(p)
            s = math.exp(-20 * ((p.min_agreement - 0.7) ** 2 + (p.scale_div_thresh - 0.2) ** 2))
            rows += [(i, f, 1.0, s * (1 + 0.1 * (f % 3))) for f in range(6)]
        yield self.spark.createDataFrame(rows, "candidate int, fold int, oos_pivots double, fold_score double")


def test_study_resumes_and_improves(spark):
    path, base = shared_path(spark, "study"), PRESETS["permissive"].low
    first = search.Study(spark, path, "s", "low", base, startup=12, prune_startup=3, seed=4)
    stub = Stub(spark)
    first.run(stub, 16, batch=8)
    assert first.trials().count() == 16
    again = search.Study(spark, path, "s", "low", base, startup=12, prune_startup=3, seed=4)
    best = again.run(stub, 40, batch=8)
    rows = again.trials().orderBy("trial").collect()
    assert [r["trial"] for r in rows] == list(range(40)) and len(stub.seen) == 40
    assert {"COMPLETE", "PRUNED"} == {r["state"] for r in rows}
    value = lambda p: math.exp(-20 * ((p["min_agreement"] - 0.7) ** 2 + (p["scale_div_thresh"] - 0.2) ** 2))
    early, late = ([value(json.loads(r["params"])) for r in part] for part in (rows[:12], rows[24:]))
    assert np.mean(late) > 1.5 * np.mean(early) and value(vars(best)) >= max(early)
    # the draws of a run that was interrupted are those of one that was not
    other = search.Study(spark, shared_path(spark, "study"), "s", "low", base, startup=12, prune_startup=3, seed=4)
    other.run(Stub(spark), 24, batch=8)
    assert [r["params"] for r in other.trials().orderBy("trial").collect()] == [r["params"] for r in rows[:24]]
    assert pipeline.watch(spark, path)[0]["n_trials"] == 40
    with pytest.raises(Exception):
        pipeline.watch(spark, path + "-none", attempts=2, wait=0.01)


def test_thresholds_score_as_the_detector_run_afresh(spark):
    """The kept features give the scores that detecting on each slice anew gives."""
    slices = engine.labelled_slices(spark, "/root/testdata/sf0.01").persist()
    preset, weights = PRESETS["permissive"], engine.cluster_weights(spark, "/root/testdata/sf0.01")
    scorer = optimize.pooled_scorer(slices, preset, "low", weights, engine.N)
    tried = [preset.low, replace(preset.low, min_agreement=0.5), replace(preset.low, pct_extreme=0.7, cooldown_bars=9), replace(preset.low, pct_extreme=0.9, min_duration=2)]
    s, seen = Slice(evaluate.SLICE), set()
    for p in tried:
        fast = {r["fold"]: (r["is_score"], r["oos_score"], r["fold_score"]) for frame in scorer.folds([p]) for r in frame.collect()}
        live = slices.join(evaluate.informative_folds(slices, "low"), "fold", "left_semi")
        marked = detect(live, s, replace(preset, low=p), ("low",)).withColumnRenamed("signal_low", "signal")
        pooled = scoring.pooled_scores(scoring.match_stats(marked, s.keys, "low", engine.N), weights, ["fold"], engine.N)
        real = {r["fold"]: (r["is_score"], r["oos_score"], r["fold_score"]) for r in pooled.collect()}
        assert fast.keys() == real.keys() and all(fast[k] == pytest.approx(real[k]) for k in real)
        seen.add(tuple(sorted(real.items())))
    assert len(seen) > 2 and any(x[1][0] > 0 for k in seen for x in k) and len(scorer.kept) <= scorer.MOST_TABLES
    scorer.close()
    assert not scorer.kept
    slices.unpersist()


def test_groups_and_clusters():
    assert U.tickers_of(["INDICES", "NONE", "FX"])[:4] == ["SPX", "NDX", "DAX", "EURGBP"]
    clusters = U.clusters()
    assert {clusters[t] for t in ("SPX", "AAPL")} == {"US_EQ"} and clusters["DAX"] == "EU_EQ" and clusters["WTI"] == "ENERGY"
    assert set(clusters) == {t for g in U.GROUPS.values() for t in g}


def test_cutpoint_ranges_against_loops(spark, monkeypatch):
    from crestline.plans import calibrate

    rng = random.Random(5)
    rows = [(k, None if rng.random() < 0.05 else float("nan") if rng.random() < 0.02 else rng.randrange(60) / 7, rng.random() < 0.3) for k in range(2) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, f double, y boolean")
    for ranges in (1, 5, 64):
        monkeypatch.setattr(calibrate, "RANGES", ranges)
        for keys in ([], ["k"]):
            for leq in (False, True):
                for r in calibrate.cutpoint_curve(df, "f", "y", keys=keys, leq=leq).collect():
                    own = [x for x in rows if not keys or x[0] == r["k"]]
                    hit = [x for x in own if x[1] is not None and x[1] == x[1] and (x[1] <= r["threshold"] if leq else x[1] >= r["threshold"])]
                    tp, pos = sum(x[2] for x in hit), sum(x[2] for x in own)
                    assert r["n_predicted"] == len(hit) and r["recall"] == pytest.approx(tp / pos)
                    assert r["score"] == pytest.approx(1.25 * tp / (len(hit) + 0.25 * pos))


def test_reports_say_what_they_leave_out(spark):
    text = report.markdown_table(spark.range(7).toDF("x").orderBy("x"), most=5)
    assert text.endswith("\n\n2 more rows") and text.count("\n| ") == 5
    with pytest.raises(ValueError):
        path = shared_path(spark, "no-time")
        spark.range(3).write.option("header", True).csv(path)
        report.read_raw(spark, path)


def test_bad_instruments_are_rows_but_bugs_are_not(spark, monkeypatch):
    out = pipeline.score_instruments(spark, {"none": "/nowhere/x.csv"}, PRESETS["permissive"]).collect()
    assert {r["error"] for r in out} == {"AnalysisException"}
    monkeypatch.setattr(B, "read_bars", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pipeline.score_instruments(spark, {"x": "y"}, PRESETS["permissive"])


def test_slices_of_many_streams(spark):
    """Folds of a stream reach only its own bars."""
    bars = engine.B.order_bars(spark, "/root/testdata/sf0.01")
    table = folds.walk_forward_table(bars)
    cut = folds.cut_slices(labels.add_labels(bars, S, (5,)), table)
    sizes = {(r["stream_id"], r["fold"], r["half"]): (r["n"], r["lo"], r["hi"]) for r in cut.groupBy("stream_id", "fold", "half").agg(F.count(F.lit(1)).alias("n"), F.min("bar").alias("lo"), F.max("bar").alias("hi")).collect()}
    for r in table.collect():
        n = r["is_end"] - r["is_start"]
        assert sizes[(r["stream_id"], r["fold"], "is")] == (n, 0, n - 1)
