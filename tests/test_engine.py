"""Sequential operators against plain loops, and the parts that SQL does not reach."""

import itertools
import json
import math
import random
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import volmodels, windows as W
from crestline.functions.windows import Slice
from crestline.operators import agreement, detector, labels, scoring, state
from crestline.plans import calibrate, evaluate, folds, optimize, params as P, pipeline, report
from crestline.sources import bars as B, universe as U
from crestline.streaming import bars as stream_bars

S = Slice()


def walk(n, seed=1, stream="a"):
    rng = random.Random(seed)
    at, rows = 100_000, []
    for i in range(n):
        o = at
        at += rng.randint(-900, 900)
        rows.append((stream, i, o, max(o, at) + rng.randint(0, 300), min(o, at) - rng.randint(0, 300), at, 100_000 * rng.randint(1, 5)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, bar long, open long, high long, low long, close long, volume long").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_400_000_000) + F.col("bar") * 86_400)
    )


def column(df, name):
    return [r[name] for r in df.orderBy("stream_id", "bar").select(name).collect()]


def test_greedy_matching_is_maximal():
    rng = random.Random(3)
    for _ in range(400):
        cap = rng.randint(2, 12)
        s = sorted(rng.sample(range(40), rng.randint(0, 5)))
        p = sorted(rng.sample(range(40), rng.randint(0, 5)))
        best = 0
        for k in range(min(len(s), len(p)), 0, -1):
            if any(all(-2 <= y - x <= cap for x, y in zip(a, b)) for a in itertools.combinations(s, k) for b in itertools.permutations(p, k)):
                best = k
                break
        assert scoring.greedy_matches(s, p, cap) == best


def test_label_runs_keep_every_other_bar(spark):
    flat = [("a", i, 10, 20 if 5 <= i <= 9 else 15, 5 if i not in range(5, 10) else 12, 10, 1) for i in range(15)]
    got = column(labels.label_pivots(frame(spark, flat), S, 2), "label")
    raw = []
    for i in range(15):
        w = range(i - 2, i + 3)
        if i < 2 or i > 12:
            raw.append(0)
            continue
        hi, lo = flat[i][3] == max(flat[j][3] for j in w), flat[i][4] == min(flat[j][4] for j in w)
        raw.append(1 if hi and not lo else -1 if lo and not hi else 0)
    for i in range(1, 15):
        if raw[i] and raw[i] == raw[i - 1]:
            raw[i] = 0
    assert got == raw


def test_structural_labels_need_room(spark):
    df = frame(spark, walk(60))
    assert set(column(labels.structural_pivots(df, S, (10, 30)), "label")) == {0}
    kept = df.withColumn("label", F.lit(1))
    assert labels.add_labels(kept, S) is kept


def test_duration_drift_and_edges(spark):
    rows = walk(300, 5)
    df = frame(spark, rows)
    hit = [r[5] % 3 > 0 for r in rows]
    got = column(state.duration(df, S, F.col("close") % 3 > 0, "d"), "d")
    dur = miss = 0
    for h, g in zip(hit, got):
        if h:
            dur, miss = dur + 1, 0
        else:
            miss += 1
            dur = 0 if miss > 1 else dur
        assert g == dur
    lb, m = 4, 3
    b = state.pivot_drift(labels.baseline_pivots(df, S, lb), S, {"drift": m})
    got, stack = column(b, "drift"), []
    for t in range(len(rows)):
        expect = 0.0
        if len(stack) >= m:
            expect = (stack[-1] - stack[-m]) / max(abs(stack[-m]), 1e-9) / (m - 1)
        assert got[t] == pytest.approx(expect, abs=1e-12)
        i = t - lb
        if i >= lb and i + lb < len(rows):
            near = rows[i - lb : i + lb + 1]
            if rows[i][3] == max(r[3] for r in near):
                stack.append(rows[i][3])
            if rows[i][4] == min(r[4] for r in near):
                stack.append(rows[i][4])
    vote = F.col("close") % 2 == 0
    edge = column(df.withColumn("e", W.edge_or_state(S, vote, 3, True)), "e")
    v = [r[5] % 2 == 0 for r in rows]
    assert edge == [x and not (i >= 3 and v[i - 3]) for i, x in enumerate(v)]


def test_cooldown(spark):
    rows = walk(200, 7) + walk(120, 8, "b")
    df = frame(spark, rows).withColumn("c", F.col("close") % 4 == 0)
    got = {(r["stream_id"], r["bar"]) for r in state.cooled(df, S, "c", 6).collect()}
    marked = state.mark_signals(df, S, {"sig": ("c", 6)})
    expect, last = set(), {}
    for r in rows:
        if r[5] % 4 == 0 and (r[0] not in last or r[1] - last[r[0]] > 6):
            last[r[0]] = r[1]
            expect.add((r[0], r[1]))
    assert got == expect
    assert {(r["stream_id"], r["bar"]) for r in marked.where("sig").collect()} == expect
    assert marked.count() == len(rows) and "c" not in marked.columns


def test_gjr_and_har_are_bounded(spark):
    df = volmodels.gjr_norm(volmodels.har_norm(frame(spark, walk(400, 9)), S), S)
    for name in ("gjr_norm", "har_norm"):
        assert all(-1 <= v <= 1 for v in column(df, name))


def test_agreement_ways_are_equal(spark):
    df = frame(spark, walk(260, 11) + walk(30, 12, "b"))
    sides = {"h": (True, 0.9), "l": (False, 0.85)}
    scales = agreement.scale_grid(2, 40, 7)
    a, b = (agreement.agreement(df, S, scales, sides, how) for how in ("windows", "arrays"))
    for name in sides:
        assert column(a, name) == pytest.approx(column(b, name), abs=1e-12)
    assert agreement.scale_grid(1, 600, 1)[0] == 2 and agreement.scale_grid(1, 600, 1)[-1] == 500
    assert column(agreement.agreement(df, S, [], sides), "h")[:2] == [0.0, 0.0]


def test_detector_matches_a_loop(spark):
    rows = walk(500, 21)
    df = frame(spark, rows)
    p = P.PRESETS["permissive"]
    full = detector.candidates(df, S, p).orderBy("bar").collect()
    out = detector.detect(df, S, p).orderBy("bar").collect()
    for x in P.SIDES:
        side, since = p.side(x), 999
        for r, o in zip(full, out):
            since += 1
            sig = r[f"gate_{x}"] and r[f"votes_{x}"] >= r[f"required_{x}"] and since > side.cooldown_bars
            since = 0 if sig else since
            assert o[f"signal_{x}"] == sig


def test_all_votes_and_methods_run(spark):
    on = dict(use_trend=True, use_volume=True, use_momentum=True, use_volatility=True, use_er_gate=True, use_gjr_asym=True, use_har_vol=True, vola_range_len=20)
    df = frame(spark, walk(120, 31))
    for method in ("ATR", "StdDev", "Intraday"):
        p = replace(P.PRESETS["permissive"], high=replace(P.PRESETS["permissive"].high, vola_method=method, momentum_velocity_mode="Trend", **on))
        votes = column(detector.candidates(df, S, p, ("high",)), "votes_high")
        assert 0 <= min(votes) and max(votes) <= 8
    with pytest.raises(ValueError):
        W.volatility_position(df, S, "none", 5, 5, "x")


def test_scores_are_bounded(spark):
    df = frame(spark, walk(600, 41))
    df = labels.structural_pivots(df, S, (5, 10, 20))
    df = detector.detect(df, S, P.PRESETS["permissive"], ("low",)).withColumnRenamed("signal_low", "signal")
    score = scoring.side_score(df, ["stream_id"], "low", {20: "label"}).first()["score"]
    assert 0 <= score <= 1
    none = scoring.side_score(df.withColumn("signal", F.lit(False)), ["stream_id"], "low", {20: "label"}).first()["score"]
    assert none == 0


def test_pooled_duplicate_at_half_weight_is_neutral(spark):
    rows = [(0, h, s, 10, t, t, 10, 2000) for h in ("is", "oos") for s, t in (("a", 8), ("b", 2))]
    stats = spark.createDataFrame(rows, "fold int, half string, stream_id string, n_signals long, tp long, matched_pivots long, total_pivots long, n_bars long")
    half = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "stream_id string, weight double")
    out = scoring.pooled_scores(stats, half, ["fold"]).first()
    target = 0.5**1.2 * (1 - math.exp(-0.5 / 0.4))
    assert out["oos_score"] == pytest.approx(target) and out["fold_score"] == pytest.approx(target)


def test_bootstrap(spark):
    assert scoring.bootstrap_indices(5).shape == (1000, 5)
    idx = scoring.bootstrap_indices(7)
    scores = np.array([0.1, 0.5, 0.2, 0.4, 0.3, 0.25, 0.35])
    lo, hi = np.percentile(scores[idx].mean(axis=1), [5, 95])
    rows = [("s", i, float(x)) for i, x in enumerate(scores)]
    out = scoring.bootstrap_lcb(spark.createDataFrame(rows, "k string, fold int, fold_score double"), ["k"]).first()
    assert (out["lcb"], out["ucb"]) == (pytest.approx(lo), pytest.approx(hi))


def test_schemes():
    s = folds.infer_scheme(1700)
    assert (s.holdout, s.inside, s.outside, s.step) == (340, 252, 63, 85)
    for _, a, b, c, d in folds.fold_rows(s):
        assert a < b and c - b == 20 and d <= s.active
    with pytest.raises(ValueError):
        folds.infer_scheme(300)
    assert folds.describe_scheme(s)["n_folds"] == len(folds.fold_rows(s))


def test_calendar_folds(spark):
    long, short = frame(spark, walk(900, 1)), frame(spark, walk(300, 2, "b")).withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + 600 * 86_400))
    plan = folds.CalendarPlan(nest=(5, 10, 20))
    bars = long.unionByName(short)
    f = folds.calendar_folds(bars, plan)
    assert f.count() >= 1
    sl = folds.calendar_slices(bars, f, plan)
    assert sl.groupBy("fold", "stream_id", "half").count().where("count < 41").count() == 0
    gap = f.select(F.datediff("oos_start", "is_end").alias("g")).distinct().collect()
    assert [r["g"] for r in gap] == [20]
    late = folds.calendar_folds(bars, replace(plan, start="2015-06-01"))
    assert all(r["is_start"].year >= 2015 for r in late.collect())
    # an era too short for a fold falls back to all history
    tiny = frame(spark, walk(30, 3, "c")).withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + 860 * 86_400))
    assert folds.calendar_folds(long.unionByName(tiny), plan).count() >= 1


def test_purged_parts_keep_the_gap(spark):
    rows = spark.range(1000).withColumnRenamed("id", "bar")
    parts = folds.purged_parts(rows, folds.purged_blocks(spark, 1000, 5, 10))
    edges = {r["block"]: r for r in folds.purged_blocks(spark, 1000, 5, 10).collect()}
    for r in parts.where("part = 'train'").collect():
        e = edges[r["block"]]
        assert r["bar"] < max(0, e["test_start"] - 10) or r["bar"] >= min(1000, e["test_end"] + 10)


def test_cutpoints(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(0, 1, 2000)
    rows = [(i, float(v), bool(v >= 1.5)) for i, v in enumerate(f)] + [(2000 + i, None, True) for i in range(20)]
    df = spark.createDataFrame(rows, "bar long, f double, y boolean")
    best = calibrate.best_cutpoint(df, "f", "y").first()
    assert abs(best["threshold"] - 1.5) < 0.15 and best["precision"] == 1.0
    assert calibrate.best_cutpoint(df, "f", "y", min_predicted=500).first()["n_predicted"] >= 500
    mirrored = df.withColumn("f", -F.col("f"))
    assert calibrate.best_cutpoint(mirrored, "f", "y", leq=True).first()["threshold"] == -best["threshold"]
    cv = calibrate.cv_cutpoint(df.where("f IS NOT NULL"), "f", "y", n_rows=2000).first()
    assert abs(cv["threshold"] - 1.5) < 0.4
    assert calibrate.best_cutpoint(df.withColumn("y", F.lit(False)), "f", "y").where("score > 0").count() == 0


def test_ascent_never_falls():
    calls = []

    def score(ps):
        calls.append(len(ps))
        return [1 - (p.min_agreement - 0.5) ** 2 - (p.scale_div_thresh - 0.35) ** 2 for p in ps]

    out = optimize.ascend(P.DEFAULT_LOW, "low", score, sweeps=3, grid_n=5)
    taken = [t["score"] for t in out.trace if t["accepted"]]
    assert taken == sorted(taken) and out.score >= taken[0]
    assert len(out.trace) <= optimize.planned_evaluations(3, len(P.active_thresholds(P.DEFAULT_LOW)), 6)
    assert optimize.grid(0.0, 1.0, 3, 0.3) == [0.0, 0.3, 0.5, 1.0]


def test_params():
    rng = random.Random(1)
    for side, least in (("high", 0.30), ("low", 0.50)):
        drawn = [P.sample_global(side, rng)["dur_extreme_pct"] for _ in range(400)]
        assert min(drawn) >= least and (side == "low" or min(drawn) < 0.5)
    assert P.trial_key("low", "pivot_drift_lookback") == "low_pivot_drift_lb"
    got = P.params_from_trial({"low_pivot_drift_lb": 7, "high_S_detect": 50}, "low")
    assert got.low.pivot_drift_lookback == 7 and got.high == P.Params().high
    with pytest.raises(ValueError):
        P.space_for("up")
    local = P.sample_local("low", P.DEFAULT_LOW, random.Random(2))
    assert 5 <= local["S_detect"] <= 60 and set(local) <= {*P.INT_BOUNDS, *P.FLOAT_BOUNDS, *P.BOOLS, *P.CATEGORIES}
    assert [k for k, _ in P.draws("low", P.DEFAULT_LOW, 2, 3, 5)] == ["local"] * 2 + ["global"] * 3
    assert detector.max_votes(P.SideParams()) == 1


def test_csv_scan_and_policy(spark, tmp_path):
    lines = ["Time,Open,High,Low,Close,Volume"] + [f"{1_400_000_000 + i * 86400},1,2,0.5,1.5,{3600 if i < 100 else 250000}" for i in range(200)]
    path = tmp_path / "SPX_1D_a_b.csv"
    path.write_text("\n".join(lines))
    bars = B.read_bars(spark, str(path), stream=F.lit("SPX_1D"))
    assert bars.count() == 200 and [r["bar"] for r in bars.orderBy("ts").limit(3).collect()] == [0, 1, 2]
    prof = B.volume_profile(bars).first()
    assert prof["quality"] == "partial"
    kept = B.apply_volume_policy(bars, "volume_required")
    assert kept.count() == 100 and kept.agg(F.min("bar")).first()[0] == 0
    assert B.apply_volume_policy(bars, "mixed") is bars
    none = bars.withColumn("volume", F.lit(3600.0))
    assert B.volume_profile(none).first()["quality"] == "none" and B.apply_volume_policy(none, "volume_required").count() == 0
    with pytest.raises(ValueError):
        B.apply_volume_policy(bars, "other")
    with pytest.raises(ValueError):
        B.normalise_headers(spark.range(1))


def test_streams(spark, tmp_path):
    for name in ("BATS_AAPL, 1D_9f4ab.csv", "SPX_1D_x_y.csv", "SP_SPX, 60_d2f5a.csv", "garbage.csv"):
        (tmp_path / name).write_text("x")
    files = U.list_files(spark, str(tmp_path))
    out = U.resolve_streams(files, ["SPX", "AAPL", "NDX", "SPX"], ["1D", "60"], {"AAPL": "tech"})
    got = [(r["stream_id"], r["cluster_id"]) for r in out.collect()]
    assert got == [("SPX_1D", "SPX"), ("SPX_60", "SPX"), ("AAPL_1D", "tech")]
    w = {r["stream_id"]: r["weight"] for r in U.cluster_weights(out).collect()}
    assert w == {"SPX_1D": 0.5, "SPX_60": 0.5, "AAPL_1D": 1.0}
    gate = U.cross_timeframe_gate(0.6, 0.5)
    assert gate["holds"] and gate["drop"] == pytest.approx(0.1)


def test_trials_and_reports(spark, tmp_path):
    path = str(tmp_path / "trials")
    optimize.append_trials(spark, path, "s", [(0, "COMPLETE", 0.4, {"a": 1}), (1, "PRUNED", None, {})])
    optimize.append_trials(spark, path, "s", [(2, "COMPLETE", 0.6, {"a": 2})])
    row = optimize.study_summary(spark.read.parquet(path)).first()
    assert (row["n_trials"], row["n_complete"], row["best_trial"]) == (3, 2, 2)
    text = report.render_report("Run", {"Study": optimize.study_summary(spark.read.parquet(path)), "Note": "x"})
    assert "| study |" in text and "## Note" in text
    report.write_text(spark, str(tmp_path / "r.md"), text)
    assert (tmp_path / "r.md").read_text() == text
    assert report.slug("S&P 500, daily") == "s_p_500_daily"
    assert 'vola_method_high = "ATR"' in report.chart_constants(P.Params(), "x") and "pct_extreme_high = 0.9600" in report.chart_constants(P.Params(), "x")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.csv").write_text("a")
    got = json.loads(report.provenance(spark, str(tmp_path / "d"), frame(spark, walk(5)), {"lcb": 0.1}))
    assert got["files"][0]["sha256"] == "ca978112ca1b" and got["streams"][0]["bars"] == 5
    marks = spark.createDataFrame([(1, 0, None)], "time long, `Strong High` int, `Regular High` int").withColumn("Strong Low", F.lit(1)).withColumn("Regular Low", F.lit(0))
    got = report.export_signals(marks).first()
    assert (got["signal_high"], got["signal_low"]) == (False, True)


def test_stability(spark):
    p = P.DEFAULT_LOW
    samples = optimize.probe(spark, "low", p, lambda ps: [1 - abs(x.min_agreement - p.min_agreement) for x in ps], 20, 20)
    out = {r["kind"]: r for r in optimize.stability(samples, 1.0).collect()}
    assert out["local"]["verdict"] == "stable" and out["local"]["mean"] > out["global"]["mean"]


def test_stream_equals_batch(spark, tmp_path):
    rows = walk(120, 51) + walk(80, 52, "b")
    df = frame(spark, rows)
    n = 5
    known = labels.baseline_pivots(df, S, n).orderBy("stream_id", "bar").collect()
    expect, before = set(), {}
    for r in known:
        for side in ("high", "low"):
            now = r[f"baseline_{side}"] is not None
            if now and not before.get((r["stream_id"], side)):
                expect.add((r["stream_id"], r["bar"] - n, side, float(r[f"baseline_{side}"])))
            before[(r["stream_id"], side)] = now
    src = str(tmp_path / "in")
    for lo in range(0, 120, 40):
        df.where((F.col("bar") >= lo) & (F.col("bar") < lo + 40)).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_bars.confirm_pivots(live, n).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["stream_id"], r["bar"], r["side"], r["price"]) for r in spark.table("alerts").collect()}
    assert got == expect


def test_streamed_bars(spark, tmp_path):
    rows = [("a", 1_400_000_000 + i * 3600, i, 100 + i % 7) for i in range(24 * 8)]
    ticks = spark.createDataFrame(rows, "stream_id string, s long, key long, px long").select("stream_id", F.timestamp_seconds("s").alias("ts"), "key", "px")
    src = str(tmp_path / "in")
    ticks.coalesce(1).write.parquet(src)
    q = stream_bars.stream_bars(spark.readStream.schema(ticks.schema).parquet(src), late="1 day").writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = {r["ts"]: tuple(r)[1:] for r in B.to_bars(ticks, "px", F.lit(1), tie=("key",)).drop("stream_id").select("ts", "open", "high", "low", "close", "volume").collect()}
    live = {r["ts"]: (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.table("days").collect()}
    assert live and all(batch[t] == v for t, v in live.items())


def test_runs(spark, tmp_path):
    df = frame(spark, walk(900, 61)).withColumn("ts", F.timestamp_seconds(F.lit(1_300_000_000) + F.col("bar") * 86_400))
    p = P.PRESETS["permissive"]
    config = pipeline.RunConfig(preset="permissive", nest=(5, 10, 20), n=20)
    scores = pipeline.walk_forward_scores(df, p, config)
    assert scores.count() == 2 * folds.walk_forward_table(df).count() > 0
    assert scores.where("fold_score > oos_score + 1e-12 OR fold_score < 0").count() == 0
    per_slice = pipeline.walk_forward_scores(df, p, replace(config, label_whole=False))
    assert per_slice.count() == scores.count()
    for r in pipeline.run_table(scores).collect():
        assert r["lcb"] <= r["mean_score"] <= r["ucb"]
    assert {r["part"] for r in pipeline.holdout_table(df, p, config).collect()} == {"is", "oos"}
    (tmp_path / "X_1D_a_b.csv").write_text("time,open,high,low,close,volume\n" + "\n".join(f"{1_300_000_000 + r[1] * 86400},{r[2]},{r[3]},{r[4]},{r[5]},{r[6]}" for r in walk(300, 5)))
    out = pipeline.score_instruments(spark, {"x": str(tmp_path / "X_1D_a_b.csv"), "y": str(tmp_path / "none.csv")}, p, config).collect()
    assert sorted((r["instrument"], r["error"] is None) for r in out) == [("x", True)] * 2 + [("y", False)] * 2
    known = spark.createDataFrame([(1_300_000_000,), (1_500_000_000,)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    assert [r["hit"] for r in pipeline.hits_near(df, known).orderBy("ts").collect()] == [True, False]


def test_bounds_and_pruning(spark):
    rows = [(c, f, 0.1 * c + 0.01 * f, 1.0) for c in range(5) for f in range(4)] + [(0, 9, 0.0, 0.0)]
    scores = spark.createDataFrame(rows, "candidate int, fold int, fold_score double, oos_pivots double")
    b = pipeline.running_bounds(scores)
    assert b.count() == 20
    pruned = {r["candidate"]: r["pruned"] for r in pipeline.median_pruned(b, startup=2, warmup=1).collect()}
    assert pruned == {0: True, 1: True, 2: False, 3: False, 4: False}
    with pytest.raises(ValueError):
        evaluate.check_shape(P.DEFAULT_LOW, replace(P.DEFAULT_LOW, S_detect=9))
    evaluate.check_shape(P.DEFAULT_LOW, replace(P.DEFAULT_LOW, min_agreement=0.5))


def test_agreement_counts():
    close = np.cumsum(np.random.default_rng(3).normal(0, 1, 200)) + 100
    high, low, n = agreement.agreement_counts(close, [3, 6, 9], 0.9, 0.9)
    m = agreement.position_matrix(close, [3, 6, 9], np.float64)
    assert n == 3 and high.tolist() == (np.nan_to_num(m, nan=0.5) > 0.9).sum(axis=0).tolist()
    assert low.tolist() == (np.nan_to_num(m, nan=0.5) < 1.0 - 0.9).sum(axis=0).tolist()
    assert agreement.agreement_counts(close, [], 0.9, 0.9)[2] == 0


_FALLING = ("agreement_arrays", "agreement_counts", "agreement_windows", "detector_candidates_high", "detector_candidates_low", "detector_debug", "detector_signals_high", "detector_signals_low", "duration", "edge_vote",
            "momentum_votes", "scale_divergence", "scale_transfer", "side_score_high", "side_score_low", "signal_match_high", "signal_match_low", "trend_vote", "vola_intraday")


@pytest.fixture(scope="module")
def falling(tmp_path_factory):
    """Orders whose walk of prices falls through zero, and stands at zero on some days."""
    d = tmp_path_factory.mktemp("falling")
    duckdb.sql(f"""COPY (SELECT i AS o_orderkey, CASE WHEN i % 2 = 0 THEN '1-URGENT' ELSE '3-MEDIUM' END AS o_orderpriority, TIMESTAMP '2001-01-01' + INTERVAL 1 DAY * (i // 6) AS o_orderdate,
      250000.0 + CASE WHEN i = 0 THEN -25000000 WHEN i = 1 THEN -20000000 WHEN i // 6 IN (0, 60, 61) THEN 0 ELSE i * 7919 * (i + 13) % 9000000 - 4600000 END AS o_totalprice
      FROM range(1500) t(i)) TO '{d}/orders.parquet'""")
    return str(d)


@pytest.mark.parametrize("name", _FALLING)
def test_prices_below_zero_against_sql(spark, falling, name):
    from crestline.queries import engine
    from test_oracle import rows

    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS FROM '{falling}/orders.parquet'")
    assert con.sql(engine.oracle_sql()["bars_daily"]).filter("close < 0").count("*").fetchall()[0][0] > 50
    assert rows(engine.queries()[name](spark, falling).toPandas()) == rows(con.sql(engine.oracle_sql()[name]).df())


def test_position_of_a_ratio_to_zero():
    close = np.array([1.0, -1.0] * 10 + [3.0, 5.0, 0.0, 0.0] + [2.0] * 30)
    m = agreement.position_matrix(close, [2], np.float64)[0]
    assert np.isnan(m[:20]).all() and not np.isnan(m[20:]).any() and (m[20:24] >= 0).all() and m[-1] == 0.5
