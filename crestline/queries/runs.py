"""Queries of files, whole runs, and the tables around a search, with SQL for the oracle."""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import agreement as ag, detector, labels, scoring
from ..plans import evaluate, folds, optimize, pipeline, report, search
from ..plans.params import PRESETS, SideParams, active_thresholds, space_for
from ..sources import bars as B, universe as U
from ..sources.scratch import shared_path
from . import sql as Q
from .engine import _CAL, _FRAMES_SQL, _SCALES, _TRIALS, _TRIALS_SQL, _WF, N, NEST, PRESET, S, cluster_weights, labelled_slices, over_bars, query, six

CONFIG = pipeline.RunConfig(preset="permissive", nest=NEST, n=N)
CAP = scoring.tolerance(N)

# Files -------------------------------------------------------------------------------


def _bar_files(spark: SparkSession, d: str) -> str:
    """Daily bars as CSV, a folder for each stream, under headers as exports have them."""
    path = shared_path(spark, "bars-csv")
    named = [F.unix_timestamp("ts").alias(" Time"), *(F.col(c).alias(c.upper() + " ") for c in B.REQUIRED)]
    B.order_bars(spark, d).select("stream_id", *named).repartition("stream_id").write.partitionBy("stream_id").option("header", True).csv(path)
    return path


def _stream_of_file():
    return F.url_decode(F.regexp_extract(F.input_file_name(), "stream_id=([^/]+)/", 1))


@query(over_bars("SELECT stream_id, bar, strftime(ts, '%Y-%m-%d') AS day, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume::DOUBLE AS volume FROM bars"))
def csv_bars(spark, d):
    """Bars read from CSV files, a stream each, headers of any case and with blanks."""
    return B.read_bars(spark, _bar_files(spark, d), stream=_stream_of_file()).select("stream_id", "bar", F.date_format("ts", "yyyy-MM-dd").alias("day"), *B.REQUIRED)


@query(over_bars("""WITH_ALL AS (SELECT stream_id, ts, open, high, low, close, volume FROM bars UNION ALL SELECT 'events', * FROM eh),
m AS (SELECT stream_id, date_trunc('month', ts) AS month, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume)::BIGINT AS volume FROM WITH_ALL GROUP BY ALL)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY month) - 1 AS bar, strftime(month, '%Y-%m') AS month, open, high, low, close, volume FROM m""").replace("WITH RECURSIVE", "WITH RECURSIVE eh AS (SELECT date_trunc('hour', t) AS ts, first(v ORDER BY t, event_id) AS open, max(v) AS high, min(v) AS low, last(v ORDER BY t, event_id) AS close, count(*) AS volume FROM (SELECT *, ts::TIMESTAMP AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL),").replace("\nWITH_ALL AS", ",\nWITH_ALL AS"))
def cross_asset_scan(spark, d):
    """Streams of different sources and time frames as one frame of months."""
    every = B.order_bars(spark, d).unionByName(B.event_bars(spark, d))
    return B.resample(every, unit="month").select("stream_id", "bar", F.date_format("ts", "yyyy-MM").alias("month"), *B.REQUIRED)


_FILES = ["SPX_1D_18710201_20260318.csv", "SP_SPX, 1D_aaa.csv", "NDX_240_a_b.csv", "TVC_DAX, 240_9f.csv", "FX_EURUSD, 1D_1.csv", "FX_IDC_GBPUSD, 240_2.csv", "AAPL_1D_x_y.csv", "COMEX_DL_GC1!, 1D_z.csv", "notes.csv", "USDSEK_60_a_b.csv"]
_GROUPS = ["INDICES", "FX", "NONE"]
_FILES_SQL = f"""f AS (SELECT unnest([{', '.join(f"'{x}'" for x in _FILES)}]) AS name),
e AS (SELECT name, regexp_extract(name, '^(.+), ([0-9A-Za-z]+)_[^,]*\\.csv$', 1) AS pre, regexp_extract(name, '^(.+), ([0-9A-Za-z]+)_[^,]*\\.csv$', 2) AS tf, string_split(regexp_replace(name, '\\.csv$', ''), '_') AS ps FROM f),
g AS (SELECT name, CASE WHEN tf IN ({_FRAMES_SQL}) THEN translate(string_split(pre, '_')[-1], '!.', '') WHEN len(ps) >= 3 AND NOT contains(name, ', ') AND ps[2] IN ({_FRAMES_SQL}) THEN ps[1] END AS ticker,
  CASE WHEN tf IN ({_FRAMES_SQL}) THEN tf WHEN len(ps) >= 3 AND NOT contains(name, ', ') AND ps[2] IN ({_FRAMES_SQL}) THEN ps[2] END AS timeframe FROM e)"""


@query(f"""WITH {_FILES_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, timeframe ORDER BY name) AS i FROM g WHERE ticker IN ('SPX', 'NDX', 'DAX', 'EURGBP', 'EURJPY', 'EURUSD', 'GBPUSD', 'USDCHF', 'USDRUB', 'USDSEK') AND timeframe IN ('1D', '240'))
SELECT ticker, timeframe, name AS path, CASE WHEN ticker IN ('SPX', 'NDX') THEN 'US_EQ' WHEN ticker = 'DAX' THEN 'EU_EQ' ELSE 'FX' END AS cluster_id, ticker || '_' || timeframe AS stream_id FROM k WHERE i = 1""")
def universe_streams(spark, d):
    """The pool's streams of some groups and time frames, the first file of each, with their clusters."""
    return U.resolve_groups(spark.createDataFrame([(n, n) for n in _FILES], "path string, name string"), _GROUPS, ["1D", "240"])


_EXPORTS = ["SPX_1D_b_TV_2.csv", "SPX_1D_a_TV_1.csv", "SPX_240_a_TV_1.csv", "SPX_1D_a_raw.csv", "SPXX_1D_a_TV_0.csv"]


@query("SELECT min(name) AS name, 'SPX' AS ticker FROM (VALUES " + ", ".join(f"('{x}')" for x in _EXPORTS) + ") t(name) WHERE regexp_matches(name, '^SPX_1D_.*_TV_.*\\.csv$')")
def enriched_lookup(spark, d):
    """The enriched export of a stream: the first by name."""
    files = spark.createDataFrame([(n, n) for n in _EXPORTS], "path string, name string")
    return report.enriched_of(files, "SPX", "1D").select("name", F.lit("SPX").alias("ticker"))


_MARKS = {"Strong High": "CASE WHEN bar % 7 = 0 THEN 1 END", "Regular High": "CASE WHEN bar % 5 = 0 THEN 0 ELSE -1 END", "Strong Low": "0", "Regular Low": "CASE WHEN bar % 11 = 3 THEN 2 END"}


@query(over_bars("SELECT stream_id, bar, coalesce(h1, 0) + coalesce(h2, 0) > 0 AS signal_high, coalesce(l1, 0) + coalesce(l2, 0) > 0 AS signal_low FROM (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in zip(("h1", "h2", "l1", "l2"), _MARKS.values())) + " FROM bars)"))
def enriched_signals(spark, d):
    """Signals from the strong and regular marks of an export."""
    marked = B.order_bars(spark, d).select("stream_id", "bar", *(F.expr(e).alias(n) for n, e in _MARKS.items()))
    return report.export_signals(marked).select("stream_id", "bar", "signal_high", "signal_low")


@query(over_bars("""x AS (SELECT stream_id, bar, close, close + CASE WHEN bar % 10 = 0 THEN 5 ELSE 0 END AS other, CASE WHEN bar % 3 = 0 THEN volume END AS v FROM bars WHERE bar % 4 <> 1)
SELECT 'close' AS "column", count(*) AS n_compared, sum((close <> other)::INT)::BIGINT AS n_mismatch, round(avg((close <> other)::INT), 9) AS rate, max(abs(close - other))::DOUBLE AS max_abs_diff FROM x
UNION ALL SELECT 'volume', count(v), 0, 0.0, 0.0 FROM x""").replace("\nx AS", ",\nx AS"))
def export_parity(spark, d):
    """A raw and an enriched export, written, read by their own readers and compared on time."""
    b = B.order_bars(spark, d).withColumn("time", F.xxhash64("stream_id") % 10**6 * 10**5 + F.col("bar"))
    raw, enriched = shared_path(spark, "raw"), shared_path(spark, "enriched")
    b.select(F.col("time").alias(" Time"), F.col("close").alias("CLOSE"), F.when(F.col("bar") % 3 == 0, F.col("volume")).alias("Volume ")).write.option("header", True).csv(raw)
    theirs = b.where("bar % 4 <> 1").withColumn("close", F.col("close") + F.when(F.col("bar") % 10 == 0, 5).otherwise(0))
    theirs.select("time", F.col("close").alias(" Close"), "volume", *(F.expr(e).alias(n) for n, e in _MARKS.items())).write.option("header", True).csv(enriched)
    return report.parity_of_exports(spark, raw, enriched, ["close", "volume"]).withColumn("rate", F.round("rate", 9))


@query(over_bars("""c AS (SELECT stream_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS a FROM bars GROUP BY stream_id), r AS (SELECT *, row_number() OVER (ORDER BY stream_id) AS i FROM c)
SELECT 1 AS line_no, '# Run' AS line UNION ALL SELECT 2, '' UNION ALL SELECT 3, '## Streams' UNION ALL SELECT 4, '' UNION ALL SELECT 5, '| stream_id | bars | first |' UNION ALL SELECT 6, '|---|---|---|'
UNION ALL SELECT (6 + i)::INT, '| ' || stream_id || ' | ' || n || ' | ' || a || ' |' FROM r""").replace("\nc AS", ",\nc AS"))
def report_lines(spark, d):
    """A report of the streams, line by line."""
    c = U.catalogue(B.order_bars(spark, d)).select("stream_id", "bars", F.date_format("first_ts", "yyyy-MM-dd").alias("first")).orderBy("stream_id")
    lines = report.render_report("Run", {"Streams": c}).rstrip("\n").split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")


# Parameters and trials ---------------------------------------------------------------

_WARM = {"low": {"low_S_detect": 17, "low_min_agreement": 0.33, "low_pivot_drift_lb": 9, "low_use_trend": True, "high_S_detect": 3}}


@query("SELECT * FROM (VALUES ('S_detect', '17'), ('min_agreement', '0.3300'), ('pivot_drift_lookback', '9'), ('use_trend', 'true'), ('cooldown_bars', '5')) t(name, value)")
def warm_start(spark, d):
    """Parameters of a side from a file with the best trial; what it does not name keeps its value."""
    path = shared_path(spark, "warm") + ".json"
    report.write_text(spark, path, json.dumps(_WARM))
    p = search.warm_start(spark, path, "low", PRESET.low)
    names = ["S_detect", "min_agreement", "pivot_drift_lookback", "use_trend", "cooldown_bars"]
    return spark.createDataFrame([(n, report.constant(getattr(p, n))) for n in names], "name string, value string")


@query(f"""WITH {_TRIALS_SQL}, w AS (SELECT study, trial, state, score FROM tr UNION ALL SELECT study, trial, 'COMPLETE', score + 0.01 FROM tr WHERE trial % 3 = 0 UNION ALL SELECT study, trial, 'PRUNED', 0.9 FROM tr WHERE trial % 4 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY study, trial ORDER BY (state = 'COMPLETE') DESC, score DESC) AS i FROM w)
SELECT study, trial, state, round(score, 9) AS score FROM k WHERE i = 1""")
def trial_journal(spark, d):
    """Trials appended by three runs, read with each trial once."""
    path = shared_path(spark, "trials")
    for study in ("a", "b"):
        own = [t for t in _TRIALS if t[0] == study]
        optimize.append_trials(spark, path, study, [(t[1], t[2], t[3], {"x": t[4]}) for t in own])
        optimize.append_trials(spark, path, study, [(t[1], "COMPLETE", t[3] + 0.01, {"x": t[4]}) for t in own if t[1] % 3 == 0])
        optimize.append_trials(spark, path, study, [(t[1], "PRUNED", 0.9, {"x": t[4]}) for t in own if t[1] % 4 == 0])
    return optimize.read_trials(spark, path).select("study", "trial", "state", F.round("score", 9).alias("score"))


@query(f"WITH {_TRIALS_SQL}, c AS (SELECT 'x' AS name, corr(x, score) AS r FROM tr UNION ALL SELECT 'y', corr(y, score) FROM tr UNION ALL SELECT 'trial', corr(trial, score) FROM tr) SELECT name, round(r, 9) AS r FROM c ORDER BY abs(r) DESC LIMIT 2")
def sensitivity_top(spark, d):
    """The parameters that go most with the score."""
    trials = spark.createDataFrame(_TRIALS, "study string, trial long, state string, score double, x double, y double")
    return optimize.sensitivity(trials, ["x", "y", "trial"], 2).select("name", F.round("r", 9).alias("r"))


_ALWAYS = ("pct_extreme", "min_agreement", "dur_extreme_pct", "scale_div_thresh", "pivot_drift_thresh", "pivot_drift_gate_mult")
_SWITCHED = (("use_volume", "vol_surge_thresh"), ("use_trend", "slope_thresh"), ("use_volatility", "vola_high_pct"), ("use_momentum_velocity", "momentum_velocity_thresh"), ("use_gjr_asym", "gjr_vote_thresh"), ("use_har_vol", "har_vote_thresh"))
_ON = {(n, s): [f for sw, f in _SWITCHED if getattr(PRESETS[n].side(s), sw)] for n in PRESETS for s in ("high", "low")}


@query(f"""WITH a AS (SELECT unnest([{', '.join(f"'{x}'" for x in _ALWAYS)}]) AS field), p(preset, side, more) AS (VALUES {', '.join(f"('{n}', '{s}', [{', '.join(repr(x) for x in on)}]::VARCHAR[])" for (n, s), on in _ON.items())})
SELECT preset, side, field FROM p, a UNION ALL SELECT preset, side, unnest(more) FROM p""")
def active_fields(spark, d):
    """The thresholds that a search moves, for each preset and side."""
    rows = [(n, s, f) for n, p in PRESETS.items() for s in ("high", "low") for f in active_thresholds(p.side(s))]
    return spark.createDataFrame(rows, "preset string, side string, field string")


_AXES = [(f, *space_for("high").floats[f], getattr(PRESET.high, f)) for f in active_thresholds(PRESET.high)]


@query("WITH a(field, lo, hi, now) AS (VALUES " + ", ".join(f"('{f}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, {now!r}::DOUBLE)" for f, lo, hi, now in _AXES) + ") SELECT field, round(lo + (hi - lo) / 4 * i, 9) AS value FROM a, range(0, 5) t(i) UNION SELECT field, round(now, 9) FROM a")
def axis_grid(spark, d):
    """Every field with every value that an ascent would try."""
    axes = spark.createDataFrame([(f, lo, hi, now) for f, lo, hi, now in _AXES], "field string, lo double, hi double, now double")
    steps = axes.crossJoin(spark.range(5)).select("field", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) / 4 * F.col("id"), 9).alias("value"))
    known = {f: {round(v, 9) for v in optimize.grid(lo, hi, 5, now)} for f, lo, hi, now in _AXES}
    tried = spark.createDataFrame([(f, v) for f, vs in known.items() for v in vs], "field string, value double")
    return steps.unionByName(axes.select("field", F.round("now", 9).alias("value"))).distinct().join(tried, ["field", "value"], "left_semi")


# Bars and labels ---------------------------------------------------------------------


@query(over_bars("SELECT stream_id, 'first' AS part, count(*) AS n, min(bar) AS lo, max(bar) AS hi FROM bars WHERE bar < 300 GROUP BY stream_id UNION ALL SELECT stream_id, 'last', count(*), min(bar), max(bar) FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY bar DESC) AS i FROM bars) WHERE i <= 200 GROUP BY stream_id"))
def first_and_last_bars(spark, d):
    """A prefix and a tail of every stream."""
    b, out = B.order_bars(spark, d), None
    for name, part in (("first", folds.prefix(b, 300)), ("last", folds.tail(b, 200))):
        agg = part.groupBy("stream_id").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.min("bar").alias("lo"), F.max("bar").alias("hi"))
        out = agg if out is None else out.unionByName(agg)
    return out


@query(over_bars("SELECT stream_id, k AS scale FROM (SELECT stream_id, count(*) AS n FROM bars GROUP BY stream_id), (SELECT unnest([10, 50, 100, 200, 500, 1000, 2000]) AS k) WHERE n >= 2 * k + 1"))
def valid_scales(spark, d):
    """The scales that each stream is long enough for."""
    n = B.order_bars(spark, d).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("stream_id", F.explode(scoring.valid_scale_column(F.col("n"), [10, 50, 100, 200, 500, 1000, 2000])).alias("scale"))


_KNOWN = ["1992-03-01", "1993-06-15", "1994-10-10", "1995-01-31", "1996-12-24", "1998-04-01", "2005-01-01"]
_KNOWN_SQL = f"kn AS (SELECT unnest([{', '.join(f'DATE {chr(39)}{x}{chr(39)}' for x in _KNOWN)}]) AS day), ev AS (SELECT DISTINCT ts::DATE AS day FROM sp WHERE label = 1)"


@query(over_bars("SELECT strftime(kn.day, '%Y-%m-%d') AS day, bool_or(coalesce(abs(date_diff('day', ev.day, kn.day)) <= 30, false)) AS hit FROM kn LEFT JOIN ev ON true GROUP BY kn.day", f"{Q.structural('bars', NEST, 'sp')}, {_KNOWN_SQL}"))
def hits_near_known(spark, d):
    """Known dates that have a top within thirty days."""
    tops = labels.structural_pivots(B.order_bars(spark, d), S, NEST).where("label = 1")
    known = spark.createDataFrame([(x,) for x in _KNOWN], "day string").select(F.to_timestamp("day").alias("ts"))
    return pipeline.hits_near(tops, known).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "hit")


@query(over_bars("""bl AS (SELECT i AS block, 2000 * i // 5 AS a, 2000 * (i + 1) // 5 AS b FROM range(0, 5) t(i))
SELECT block::INT AS block, CASE WHEN bar >= a AND bar < b THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(bar)::BIGINT AS bars FROM bars, bl WHERE bar >= a AND bar < b OR bar < a - 10 OR bar >= b + 10 GROUP BY ALL""").replace("\nbl AS", ",\nbl AS"))
def purged_parts(spark, d):
    """Test and train rows of purged blocks; rows of an embargo are in neither."""
    parts = folds.purged_parts(B.order_bars(spark, d), folds.purged_blocks(spark, 2000, 5, 10))
    return parts.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bar").alias("bars"))


_AGREE64 = Q.agreement_ctes("bars", _SCALES, {"hi": (True, 0.80), "lo": (False, 0.80)}, "agr").replace("AS FLOAT", "AS DOUBLE")


@query(over_bars(f"SELECT stream_id, bar, round(hi * {len(_SCALES)})::BIGINT AS n_high, round(lo * {len(_SCALES)})::BIGINT AS n_low, {len(_SCALES)}::BIGINT AS n_scales FROM agr", _AGREE64))
def agreement_counts(spark, d):
    """Scales at either extreme, positions in 64 bits."""
    return ag.counted(B.order_bars(spark, d), S, _SCALES, 0.80, 0.80)


_LOW = PRESET.low
_DEBUG = Q.detector_ctes("bars", "low", _LOW, PRESET.baseline_lb, "det")


@query(over_bars("SELECT stream_id, bar, round(drift, 9) + 0.0 AS drift, round(position, 6) AS position, round(velocity, 9) + 0.0 AS velocity, reached, round(agree, 6) AS agree, dur AS duration, gate, votes, required, baseline_high, baseline_low FROM det", _DEBUG))
def detector_debug(spark, d):
    """Every feature, gate and vote behind the signals of a side."""
    c = detector.detect(B.order_bars(spark, d), S, PRESET, ("low",), debug=True)
    return c.select(
        "stream_id", "bar", F.round("drift_low", 9).alias("drift"), F.round("position_low", 6).alias("position"), F.round("velocity_low", 9).alias("velocity"), F.col("reached_low").alias("reached"),
        F.round("agree_low", 6).alias("agree"), F.col("duration_low").alias("duration"), F.col("gate_low").alias("gate"), F.col("votes_low").alias("votes"), F.col("required_low").alias("required"), "baseline_high", "baseline_low",
    )


# Folds and runs ----------------------------------------------------------------------


@query(over_bars("SELECT DISTINCT CASE label WHEN 1 THEN 'high' ELSE 'low' END AS side, fold::INT AS fold FROM cs WHERE half = 'oos' AND label <> 0", _CAL))
def informative_folds(spark, d):
    """Folds whose outside halves hold a label of the side."""
    slices = labelled_slices(spark, d)
    parts = [evaluate.informative_folds(slices, s).select(F.lit(s).alias("side"), "fold") for s in ("high", "low")]
    return parts[0].unionByName(parts[1])


@query(over_bars("SELECT fold::INT AS fold, round(sum(w * (label = 1)::INT), 9) AS pivots FROM (SELECT *, CASE WHEN stream_id IN ('1-URGENT', '2-HIGH') THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM cs WHERE half = 'oos') GROUP BY fold HAVING sum(w * (label = 1)::INT) > 0", _CAL))
def pooled_informative_folds(spark, d):
    """Folds that score: their weighted pivots outside."""
    scores = evaluate.score_candidates(evaluate.features(labelled_slices(spark, d), PRESET, "high"), "high", [(0, PRESET.high)], cluster_weights(spark, d), N)
    return scores.where("oos_pivots > 0").select("fold", F.round("oos_pivots", 9).alias("pivots"))


def _side_ctes(src: str, side: str, keys: str, out: str) -> str:
    p = PRESET.side(side)
    return f"""{Q.detector_ctes(src, side, p, PRESET.baseline_lb, out + 'd', keys)},
{Q.cooled_ctes(out + 'd', p.cooldown_bars, out + 's', keys)},
{Q.match_ctes(src, out + 's', side, CAP, out, keys)}"""


_K3 = "stream_id, fold, half"
_RUN = f"""{Q.structural('bars', NEST, 'lab')},
{_WF},
wh AS (SELECT stream_id, fold, 'is' AS half, a AS lo_, a + inside AS hi_ FROM wf UNION ALL SELECT stream_id, fold, 'oos', a + inside + 20, a + inside + 20 + outside FROM wf),
ws AS (SELECT b.* EXCLUDE (bar), wh.fold, wh.half, b.bar - wh.lo_ AS bar FROM lab b JOIN wh USING (stream_id) WHERE b.bar >= lo_ AND b.bar < hi_),
{_side_ctes('ws', 'high', _K3, 'mh')},
{_side_ctes('ws', 'low', _K3, 'ml')},
st AS (SELECT *, 'high' AS side FROM mh UNION ALL SELECT *, 'low' FROM ml)"""
_RUN_SCORES = f"""{_RUN},
sc AS (SELECT *, min(n_bars) OVER (PARTITION BY stream_id, fold, side) AS least FROM st),
sd AS (SELECT *, CASE WHEN least >= {2 * N + 1} THEN {Q.score(N)} ELSE 0.0 END AS score FROM sc),
sf AS (SELECT stream_id, side, fold, coalesce(max(CASE WHEN half = 'is' THEN score END), 0.0) AS is_score, coalesce(max(CASE WHEN half = 'oos' THEN score END), 0.0) AS oos_score FROM sd GROUP BY ALL),
fs AS (SELECT *, greatest(0.0, is_score - oos_score) AS gap, oos_score * exp(-2.0 * greatest(0.0, is_score - oos_score)) AS fold_score FROM sf)"""


@query(over_bars("SELECT stream_id, side, fold::BIGINT AS fold, round(is_score, 9) AS is_score, round(oos_score, 9) AS oos_score, round(gap, 9) AS gap, round(fold_score, 9) AS fold_score FROM fs", _RUN_SCORES))
def walk_forward_scores(spark, d):
    """Scores of both sides on every stream's own folds, each half with a warm-up of its own."""
    out = pipeline.walk_forward_scores(B.order_bars(spark, d), PRESET, CONFIG)
    return out.select("stream_id", "side", "fold", *(F.round(c, 9).alias(c) for c in ("is_score", "oos_score", "gap", "fold_score")))


_DRAWS = "\nUNION ALL ".join(f"SELECT {n} AS n, unnest([{', '.join('[' + ','.join(map(str, r)) + ']' for r in scoring.bootstrap_indices(n).tolist())}]) AS idx" for n in range(2, 17))


@query(over_bars("""SELECT stream_id, side, any_value(f.n) AS n_folds, round(any_value(mean), 9) AS mean_score, round(coalesce(quantile_cont(m, 0.05), any_value(mean)), 9) AS lcb, round(coalesce(quantile_cont(m, 0.95), any_value(mean)), 9) AS ucb FROM (
 SELECT f.*, list_avg(list_transform(idx, lambda i: v[i + 1])) AS m FROM ff f LEFT JOIN dr USING (n)) f GROUP BY stream_id, side""", f"{_RUN_SCORES},\nff AS (SELECT stream_id, side, count(*) AS n, avg(fold_score) AS mean, list(fold_score ORDER BY fold) AS v FROM fs GROUP BY ALL),\ndr AS ({_DRAWS})"))
def walk_forward_bounds(spark, d):
    """Bounds of the mean of each stream's folds."""
    out = pipeline.run_table(pipeline.walk_forward_scores(B.order_bars(spark, d), PRESET, CONFIG))
    return out.select("stream_id", "side", "n_folds", *(F.round(c, 9).alias(c) for c in ("mean_score", "lcb", "ucb")))


@query(over_bars("""SELECT side, component, round(avg(value), 9) AS mean, count(*) AS n_folds FROM (
 UNPIVOT (SELECT side, p AS precision, r AS recall, 1 - exp(-r / """ + repr(0.4 * (100 / N) ** 0.5) + """) AS saturated_recall, least(1.0, n_signals / n_bars / 0.001) AS frequency, 2 * a * b / (a * a + b * b) AS excess
  FROM (SELECT *, CASE WHEN n_signals > 0 THEN tp / n_signals ELSE 0.0 END AS p, CASE WHEN total_pivots > 0 THEN tp / total_pivots ELSE 0.0 END AS r, greatest(n_signals, 1.0) AS a, greatest(total_pivots, 1.0) AS b FROM st WHERE half = 'oos'))
 ON precision, recall, saturated_recall, frequency, excess INTO NAME component VALUE value) GROUP BY side, component""", _RUN))
def fold_components(spark, d):
    """What the scores outside are made of, on average over all folds."""
    return pipeline.fold_components(B.order_bars(spark, d), PRESET, CONFIG).select("side", "component", F.round("mean", 9).alias("mean"), "n_folds")


_HOLD = f"""{Q.structural('bars', NEST, 'lab')},
{_WF},
ho AS (SELECT lab.* EXCLUDE (bar), CASE WHEN bar < n - greatest(round_even(0.20 * n, 0), 63) THEN 'is' ELSE 'oos' END AS part, bar AS bar0 FROM lab JOIN wn USING (stream_id)),
hp AS (SELECT * EXCLUDE (bar0), row_number() OVER (PARTITION BY stream_id, part ORDER BY bar0) - 1 AS bar FROM ho),
{_side_ctes('hp', 'high', 'stream_id, part', 'mh')},
{_side_ctes('hp', 'low', 'stream_id, part', 'ml')},
st AS (SELECT *, 'high' AS side FROM mh UNION ALL SELECT *, 'low' FROM ml)"""


@query(over_bars(f"SELECT stream_id, part, side, round(CASE WHEN n_bars >= {2 * N + 1} THEN {Q.score(N)} ELSE 0.0 END, 9) AS score FROM st", _HOLD))
def holdout_scores(spark, d):
    """Scores before and in the holdout of each stream."""
    return pipeline.holdout_table(B.order_bars(spark, d), PRESET, CONFIG).withColumn("score", F.round("score", 9))


_BOTH = f"{Q.structural('bars', NEST, 'lab')},\n{_side_ctes('lab', 'high', 'stream_id', 'mh')},\n{_side_ctes('lab', 'low', 'stream_id', 'ml')},\nst AS (SELECT *, 'high' AS side FROM mh UNION ALL SELECT *, 'low' FROM ml)"


@query(over_bars(f"SELECT stream_id AS instrument, side, round({Q.score(N)}, 9) AS score, CAST(NULL AS VARCHAR) AS error FROM st UNION ALL SELECT 'MISSING', s, NULL, 'AnalysisException' FROM (SELECT unnest(['high', 'low']) AS s)", _BOTH))
def instrument_scores(spark, d):
    """Both sides' scores of every instrument's file; a file that is not there has error rows."""
    path = _bar_files(spark, d)
    names = [r[0] for r in B.order_ticks(spark, d, walk=False).select("stream_id").distinct().collect()]
    paths = {n: f"{path}/stream_id={n}" for n in names} | {"MISSING": f"{path}/none"}
    return pipeline.score_instruments(spark, paths, PRESET, CONFIG).withColumn("score", F.round("score", 9))


_WEEK = f"""{Q.structural('bars', NEST, 'lab')},
wk0 AS (SELECT stream_id, date_trunc('week', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume)::BIGINT AS volume FROM bars GROUP BY ALL),
wk AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts) - 1 AS bar FROM wk0),
{Q.structural('wk', NEST, 'wl')},
{_side_ctes('lab', 'low', 'stream_id', 'ml')},
{_side_ctes('wl', 'low', 'stream_id', 'mw')},
pr AS (SELECT a.stream_id, CASE WHEN a.n_signals > 0 THEN a.tp / a.n_signals ELSE 0.0 END AS p, CASE WHEN b.n_signals > 0 THEN b.tp / b.n_signals ELSE 0.0 END AS q FROM ml a LEFT JOIN mw b USING (stream_id))"""


@query(over_bars("SELECT stream_id, round(p, 9) AS base_precision, round(q, 9) AS other_precision, round(p - q, 9) + 0.0 AS drop, p - q <= 0.15 AS holds FROM pr", _WEEK))
def scale_transfer(spark, d):
    """Whether the precision on days holds on weeks."""
    out = pipeline.scale_transfer(B.order_bars(spark, d), PRESET, "low", config=CONFIG)
    return out.select("stream_id", *(F.round(c, 9).alias(c) for c in ("base_precision", "other_precision", "drop")), "holds")


@query(over_bars("SELECT stream_id, bar, label FROM sp WHERE label <> 0", Q.structural("bars", labels.NEST, "sp")))
def published_labels(spark, d):
    """Turning points that all three published scales agree on."""
    found: DataFrame = labels.add_labels(B.order_bars(spark, d), S)
    return found.where("label <> 0").select("stream_id", "bar", F.col("label").cast("int").alias("label"))


_P = asdict(PRESET.low)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f.name}', '{report.constant(_P[f.name])}')" for f in fields(SideParams)) + ") t(name, value)")
def trial_params(spark, d):
    """A trial's names and values turned back into parameters of a side."""
    trial = {f"low_{'pivot_drift_lb' if k == 'pivot_drift_lookback' else k}": v for k, v in _P.items()}
    from ..plans.params import params_from_trial

    p = params_from_trial(trial, "low").low
    return spark.createDataFrame([(k, report.constant(v)) for k, v in asdict(p).items()], "name string, value string")
