"""Queries over the driver's tables, one or more for each operator, with SQL for the oracle."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import volmodels, windows as W
from ..functions.windows import Slice
from ..operators import agreement as ag, detector, labels, scoring, state
from ..plans import calibrate, evaluate, folds, optimize, report
from ..plans.params import PRESETS
from ..sources import bars as B, universe as U
from . import sql as Q

S = Slice()
NEST = (5, 10, 20)
N = 20
PRESET = PRESETS["permissive"]
PLAN = folds.CalendarPlan(nest=NEST)

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        _queries[name or f.__name__] = f
        if oracle is not None:
            _sql[name or f.__name__] = oracle
        return f

    return add


def over_bars(select: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {Q.BARS}{',' + chr(10) + ctes if ctes else ''}\n{select}"


def six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# Sources -----------------------------------------------------------------------------


@query(over_bars("SELECT stream_id, bar, strftime(ts, '%Y-%m-%d') AS day, open, high, low, close, volume FROM bars"))
def bars_daily(spark, d):
    """Daily bars of the order streams."""
    return B.order_bars(spark, d).select("stream_id", "bar", F.date_format("ts", "yyyy-MM-dd").alias("day"), *B.REQUIRED)


@query("""WITH h AS (SELECT date_trunc('hour', ts::TIMESTAMP) AS ts, first(v ORDER BY t, event_id) AS open, max(v) AS high, min(v) AS low, last(v ORDER BY t, event_id) AS close, count(*) AS volume
 FROM (SELECT *, ts::TIMESTAMP AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL),
d AS (SELECT date_trunc('day', ts) AS day, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume)::BIGINT AS volume FROM h GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS day, open, high, low, close, volume FROM d WHERE close IS NOT NULL AND volume > 0""")
def events_resampled(spark, d):
    """Hourly bars of the events, resampled to days."""
    return B.resample(B.event_bars(spark, d)).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), *B.REQUIRED)


@query("""WITH t AS (SELECT o_orderpriority AS stream_id, o_orderdate::TIMESTAMP AS ts, count(*) AS n FROM orders GROUP BY ALL)
SELECT stream_id, sum(n)::BIGINT AS bars, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, sum((n > 1)::INT)::BIGINT AS duplicates FROM t GROUP BY ALL""")
def stream_catalog(spark, d):
    """Rows, span and repeated times of each stream."""
    c = U.catalogue(B.order_ticks(spark, d, walk=False))
    return c.select("stream_id", "bars", F.date_format("first_ts", "yyyy-MM-dd").alias("first_day"), F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"), "duplicates")


_CUT = {"1-URGENT": "1990-01-01", "2-HIGH": "2100-01-01", "3-MEDIUM": "1996-01-01", "4-NOT SPECIFIED": "1995-06-01", "5-LOW": "1994-01-01"}
_VOLUME_SQL = "vb AS (SELECT * EXCLUDE (volume), CASE WHEN ts < CASE stream_id " + " ".join(f"WHEN '{k}' THEN TIMESTAMP '{v}'" for k, v in _CUT.items()) + " END THEN 3600 ELSE volume END AS volume FROM bars)"
_PROFILE_SQL = _VOLUME_SQL + """,
vp AS (SELECT *, (volume IN (0, 2400, 3596, 3597, 3598, 3599, 3600, 3601) OR volume < 100000)::INT AS p FROM vb),
va AS (SELECT *, avg(p) OVER (PARTITION BY stream_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) AS ahead FROM vp),
vs AS (SELECT stream_id, avg(p) AS share, min(ts) AS start, min(CASE WHEN ahead < 0.05 THEN ts END) AS onset FROM va GROUP BY stream_id),
prof AS (SELECT stream_id, CASE WHEN share < 0.05 THEN 'full' WHEN share > 0.95 THEN 'none' ELSE 'partial' END AS quality, CASE WHEN share < 0.05 THEN start WHEN share <= 0.95 THEN onset END AS real_from, share FROM vs)"""


def _with_placeholders(spark, d) -> DataFrame:
    cut = F.create_map(*(F.lit(x) for kv in _CUT.items() for x in kv))
    b = B.order_bars(spark, d)
    return b.withColumn("volume", F.when(F.col("ts") < cut[F.col("stream_id")].cast("timestamp"), 3600).otherwise(F.col("volume")))


@query(over_bars("SELECT stream_id, quality, strftime(real_from, '%Y-%m-%d') AS real_from, round(share, 6) AS placeholder_share FROM prof", _PROFILE_SQL))
def volume_profile(spark, d):
    """Quality of each stream's volume."""
    p = B.volume_profile(_with_placeholders(spark, d))
    return p.select("stream_id", "quality", F.date_format("real_from", "yyyy-MM-dd").alias("real_from"), *six("placeholder_share"))


@query(over_bars("""SELECT stream_id, count(*) AS n_bars, strftime(min(ts), '%Y-%m-%d') AS first_day, sum(volume)::BIGINT AS volume FROM (
 SELECT vb.*, min(CASE WHEN volume >= 100000 THEN ts END) OVER (PARTITION BY stream_id) AS f FROM vb JOIN prof USING (stream_id) WHERE quality <> 'none' AND ts >= real_from) WHERE ts >= f GROUP BY ALL""", _PROFILE_SQL))
def volume_policy(spark, d):
    """What is left of each stream where volume is required."""
    kept = B.apply_volume_policy(_with_placeholders(spark, d), "volume_required")
    return kept.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_bars"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.sum("volume").alias("volume"))


_NAMES = ["BATS_AAPL, 1D_9f4ab.csv", "COMEX_DL_GC1!, 240_2d42d.csv", "SP_SPX, 60_d2f5a.csv", "NASDAQ_DLY_NDX, 1_x.csv", "garbage.csv", "SPX_1D_18710201_20260318.csv", "NDX_7D_a_b.csv", "AAPL_1D.csv"]
_FRAMES_SQL = ", ".join(f"'{x}'" for x in U.TIMEFRAMES)


@query(f"""WITH f AS (SELECT unnest([{', '.join(f"'{x}'" for x in _NAMES)}]) AS name),
e AS (SELECT name, regexp_extract(name, '^(.+), ([0-9A-Za-z]+)_[^,]*\\.csv$', 1) AS pre, regexp_extract(name, '^(.+), ([0-9A-Za-z]+)_[^,]*\\.csv$', 2) AS tf, string_split(regexp_replace(name, '\\.csv$', ''), '_') AS ps FROM f),
g AS (SELECT *, CASE tf WHEN '1' THEN '1m' WHEN 'D' THEN '1D' WHEN 'W' THEN '1W' WHEN 'M' THEN '1M' ELSE tf END AS et, CASE ps[2] WHEN '1' THEN '1m' WHEN 'D' THEN '1D' WHEN 'W' THEN '1W' WHEN 'M' THEN '1M' ELSE ps[2] END AS ct FROM e)
SELECT name, CASE WHEN et IN ({_FRAMES_SQL}) THEN translate(string_split(pre, '_')[-1], '!.', '') WHEN len(ps) >= 3 AND NOT contains(name, ', ') AND ct IN ({_FRAMES_SQL}) THEN ps[1] END AS ticker,
 CASE WHEN et IN ({_FRAMES_SQL}) THEN et WHEN len(ps) >= 3 AND NOT contains(name, ', ') AND ct IN ({_FRAMES_SQL}) THEN ct END AS timeframe FROM g""")
def filename_parse(spark, d):
    """Ticker and time frame from either form of file name."""
    return U.parse_names(spark.createDataFrame([(n,) for n in _NAMES], "name string"))


_CLUSTERS = {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "slow"}


@query("""WITH s AS (SELECT DISTINCT o_orderpriority AS stream_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderpriority = '3-MEDIUM' THEN 'slow' ELSE o_orderpriority END AS c FROM orders)
SELECT stream_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY c) AS weight FROM s""")
def cluster_weights(spark, d):
    """One by the size of a stream's cluster."""
    streams = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("stream_id")).distinct()
    groups = F.create_map(*(F.lit(x) for kv in _CLUSTERS.items() for x in kv))
    return U.cluster_weights(streams.withColumn("cluster_id", F.coalesce(F.try_element_at(groups, F.col("stream_id")), F.col("stream_id"))))


# Windows -----------------------------------------------------------------------------


def feature(name: str, expr: str, build, ctes: str = "", src: str = "bars", digits: int = 6):
    """A query of one column over all bars."""
    def run(spark, d):
        df = build(B.order_bars(spark, d))
        return df.select("stream_id", "bar", F.round(name, digits).alias(name))

    run.__doc__ = f"{name} of every bar."
    query(over_bars(f"SELECT stream_id, bar, round({expr}, {digits}) AS {name} FROM {src}", ctes), name)(run)


_lagc = Q.lag("close")
_TR = f"tr AS (SELECT *, greatest(high - low, abs(high - {_lagc}), abs(low - {_lagc}))::DOUBLE AS tr FROM bars)"
feature("sma", Q.full("avg", "close", 26), lambda b: W.sma(b, S, "close", 26, "sma"))
feature("atr", Q.full("avg", "tr", 14), lambda b: W.atr(b, S, 14, "atr"), _TR, "tr")
feature("stdev", Q.full("stddev_samp", "close", 20), lambda b: W.stdev(b, S, "close", 20, "stdev"), digits=2)
feature("pir", Q.pir("close", 50), lambda b: W.pir(b, S, "close", 50, "pir"))


def _regr(fn: str, n: int) -> str:
    w = Q.over(n=n)
    return f"{fn}(close::DOUBLE, bar::DOUBLE) {w}"


feature("linreg_slope", f"CASE WHEN count(close) {Q.over(n=26)} = 26 THEN {_regr('regr_slope', 26)} END", lambda b: W.linreg(b, S, "close", 26, slope="linreg_slope"), digits=2)
feature("linreg_value", f"CASE WHEN count(close) {Q.over(n=26)} = 26 THEN {_regr('regr_slope', 26)} * bar + {_regr('regr_intercept', 26)} END", lambda b: W.linreg(b, S, "close", 26, value="linreg_value"), digits=2)


@query(over_bars(f"SELECT stream_id, bar, {Q.extreme('high', 10, True)} AS pivot_high, {Q.extreme('low', 10, False)} AS pivot_low, {Q.gate('high', 23, True)} AS gate_high, {Q.gate('low', 58, False)} AS gate_low FROM bars"))
def extremes(spark, d):
    """Centred extremes and the price gates of both sides."""
    return B.order_bars(spark, d).select("stream_id", "bar", W.extreme(S, "high", 10, True).alias("pivot_high"), W.extreme(S, "low", 10, False).alias("pivot_low"), W.price_gate(S, "high", 23, True).alias("gate_high"), W.price_gate(S, "low", 58, False).alias("gate_low"))


_ER = f"st AS (SELECT *, abs(close - {_lagc})::DOUBLE AS step, (close - {Q.lag('close', 28)})::DOUBLE AS net FROM bars), er AS (SELECT *, abs(net) / greatest({Q.full('sum', 'step', 28)}, 1e-10) AS er, net / greatest({Q.full('sum', 'step', 28)}, 1e-10) AS er_directional FROM st)"


@query(over_bars(f"SELECT stream_id, bar, round(er, 6) AS er, round(er_directional, 6) AS er_directional, coalesce(er < {Q.lag('er')}, false) AS gate FROM er", _ER))
def er_gate(spark, d):
    """Efficiency ratio and its gate."""
    b = W.efficiency_ratio(B.order_bars(spark, d), S, 28, "er")
    b = W.efficiency_ratio(b, S, 28, "er_directional", True)
    return b.select("stream_id", "bar", *six("er", "er_directional"), W.er_gate(S, "er").alias("gate"))


_HAR = f"""gk AS (SELECT *, greatest(0.5 * pow(greatest(ln(high / low::DOUBLE), 1e-10), 2) - {2 * math.log(2) - 1!r} * pow(ln(close / open::DOUBLE), 2), 1e-10) AS gk FROM bars),
hv AS (SELECT *, sqrt(0.36 * gk + 0.28 * coalesce({Q.full('avg', 'gk', 5)}, gk) + 0.28 * coalesce({Q.full('avg', 'gk', 22)}, gk)) / sqrt(gk) AS ratio FROM gk)"""
feature("har_norm", "least(greatest((ratio - 1) / 0.5, -1.0), 1.0)", lambda b: volmodels.har_norm(b, S), _HAR, "hv")
_GJR = f"""g1 AS (SELECT *, coalesce(ln(close / ({_lagc})::DOUBLE), 0.0) AS r FROM bars),
g2 AS (SELECT *, r * r AS r2 FROM g1),
g3 AS (SELECT *, {Q.full('avg', 'r2', 252)} AS lr FROM g2),
g4 AS (SELECT stream_id, bar, r, CASE WHEN lr IS NULL THEN greatest(r2, 1e-12) ELSE greatest(greatest(lr, 1e-12) * {1 - 0.03 - 0.90 - 0.08 / 2!r}, 1e-12) END AS w FROM g3),
g5 AS (SELECT stream_id, bar, r, greatest(r * r, 1e-12) AS g, greatest(r * r, 1e-12) AS s FROM g4 WHERE bar = 0
 UNION ALL SELECT n.stream_id, n.bar, n.r, n.w + (0.03 + 0.08 * (p.r < 0)::INT) * p.r * p.r + 0.9 * p.g, n.w + (0.03 + 0.04) * p.r * p.r + 0.9 * p.s FROM g5 p JOIN g4 n ON n.stream_id = p.stream_id AND n.bar = p.bar + 1)"""
feature("gjr_norm", "least(greatest((g / s - 1) / 0.1, -1.0), 1.0)", lambda b: volmodels.gjr_norm(b, S), _GJR, "g5")

_TREND = f"""t1 AS (SELECT *, {Q.full('avg', 'close', 26)} AS m, CASE WHEN count(close) {Q.over(n=26)} = 26 THEN {_regr('regr_slope', 26)} END AS l FROM bars),
t2 AS (SELECT *, coalesce(m - {Q.lag('m', 6)}, 0.0) / (6 * m) * 1000 AS slope, l / m * 1000 AS line FROM t1)"""


@query(over_bars("SELECT stream_id, bar, round(slope, 6) + 0.0 AS slope, round(line, 6) + 0.0 AS line, coalesce(slope > 0.15 AND line > 0.15, false) AS up, coalesce(slope < -0.15 AND line < -0.15, false) AS down FROM t2", _TREND))
def trend_vote(spark, d):
    """Slopes of mean and regression line, and their votes."""
    b = W.trend(B.order_bars(spark, d), S, 26, "slope", "line")
    up, down = (F.col("slope") > 0.15) & (F.col("line") > 0.15), (F.col("slope") < -0.15) & (F.col("line") < -0.15)
    return b.select("stream_id", "bar", *six("slope", "line"), W.is_true(up).alias("up"), W.is_true(down).alias("down"))


_MOM = f"""m1 AS (SELECT *, (close - {Q.lag('close', 12)}) / ({Q.lag('close', 12)})::DOUBLE AS pr, (volume - {Q.lag('volume', 12)}) / greatest({Q.lag('volume', 12)}, 1)::DOUBLE AS vr, {Q.full('avg', 'volume', 3)} / nullif({Q.full('avg', 'volume', 12)}, 0) AS surge FROM bars),
m2 AS (SELECT *, pr * vr AS divergence, pr - {Q.lag('pr')} AS velocity FROM m1)"""


@query(over_bars("SELECT stream_id, bar, round(surge, 6) AS surge, round(divergence, 6) + 0.0 AS divergence, round(velocity, 9) + 0.0 AS velocity, coalesce(divergence < 0, false) AS diverges, coalesce(velocity <= -0.014, false) AS falls, coalesce(velocity >= 0.007, false) AS rises FROM m2", _MOM))
def momentum_votes(spark, d):
    """Volume surge, momentum divergence and velocity."""
    b = W.momentum(W.volume_surge(B.order_bars(spark, d), S, 12, "surge"), S, 12, "divergence", "velocity")
    v = F.col("velocity")
    return b.select("stream_id", "bar", *six("surge", "divergence"), F.round(v, 9).alias("velocity"), W.is_true(F.col("divergence") < 0).alias("diverges"), W.is_true(v <= -0.014).alias("falls"), W.is_true(v >= 0.007).alias("rises"))


for _m, _src in (("ATR", f"{_TR}, v1 AS (SELECT *, {Q.full('avg', 'tr', 26)} AS vola FROM tr)"), ("StdDev", f"v1 AS (SELECT *, {Q.full('stddev_samp', 'close', 26)} AS vola FROM bars)"), ("Intraday", f"v0 AS (SELECT *, (high - low) / close::DOUBLE AS day FROM bars), v1 AS (SELECT *, {Q.full('avg', 'day', 26)} AS vola FROM v0)")):
    _name = f"vola_{_m.lower()}"
    feature(_name, Q.pir("vola", 20), lambda b, m=_m, n=_name: W.volatility_position(b, S, m, 26, 20, n), _src, "v1")

_SCALES = list(range(3, 46, 3))
_SIDES = {"agree_high": (True, 0.80), "agree_low": (False, 0.80)}
_AGREE = Q.agreement_ctes("bars", _SCALES, _SIDES, "agr")
for _how in ("windows", "arrays"):
    def _agreement(spark, d, how=_how):
        df = ag.agreement(B.order_bars(spark, d), S, _SCALES, _SIDES, how)
        return df.select("stream_id", "bar", *six("agree_high", "agree_low"))

    _agreement.__doc__ = f"Share of scales at an extreme, by {_how}."
    query(over_bars("SELECT stream_id, bar, round(agree_high, 6) AS agree_high, round(agree_low, 6) AS agree_low FROM agr", _AGREE), f"agreement_{_how}")(_agreement)

_POS = f"s1 AS (SELECT *, close / {Q.full('avg', 'close', 12)} AS rel FROM agr), s2 AS (SELECT *, {Q.pir('rel', 20)} AS position FROM s1)"


@query(over_bars("SELECT stream_id, bar, round(position, 6) AS position, coalesce(abs(position - agree_high) > 0.35, false) AS apart_high, coalesce(abs(1.0 - position - agree_low) > 0.39, false) AS apart_low FROM s2", f"{_AGREE}, {_POS}"))
def scale_divergence(spark, d):
    """Where one scale and all scales disagree."""
    df = ag.agreement(B.order_bars(spark, d), S, _SCALES, _SIDES, "windows")
    df = W.sma(df, S, "close", 12, "m").withColumn("rel", W.ratio(F.col("close"), F.col("m")))
    df = W.pir(df, S, "rel", 20, "position")
    p = F.col("position")
    return df.select("stream_id", "bar", *six("position"), W.is_true(F.abs(p - F.col("agree_high")) > 0.35).alias("apart_high"), W.is_true(F.abs(1.0 - p - F.col("agree_low")) > 0.39).alias("apart_low"))


@query(over_bars("SELECT stream_id, bar, dur AS duration FROM du", f"{_AGREE}, {Q.duration_ctes('agr', 'agree_high > 0.4', 'du')}"))
def duration(spark, d):
    """Bars at the extreme, one miss forgiven."""
    df = ag.agreement(B.order_bars(spark, d), S, _SCALES, _SIDES, "windows")
    return state.duration(df, S, F.col("agree_high") > 0.4, "duration").select("stream_id", "bar", "duration")


@query(over_bars("SELECT stream_id, bar, round(drift, 9) + 0.0 AS drift, baseline_high, baseline_low FROM dr", Q.drift_ctes("bars", 5, 20, "dr")))
def pivot_drift(spark, d):
    """Confirmed pivots and the drift over the last five."""
    b = state.pivot_drift(labels.baseline_pivots(B.order_bars(spark, d), S, 20), S, {"drift": 5})
    return b.select("stream_id", "bar", F.round("drift", 9).alias("drift"), "baseline_high", "baseline_low")


@query(over_bars(f"SELECT stream_id, bar, v AS state, v AND NOT coalesce({Q.lag('v', 5)}, false) AS edge FROM ev", f"{_AGREE}, ev AS (SELECT *, agree_high > 0.4 AS v FROM agr)"))
def edge_vote(spark, d):
    """A vote as a state, and on its edge."""
    df = ag.agreement(B.order_bars(spark, d), S, _SCALES, _SIDES, "windows").withColumn("state", F.col("agree_high") > 0.4)
    return df.select("stream_id", "bar", "state", W.edge_or_state(S, F.col("state"), 5, True).alias("edge"))


# Labels ------------------------------------------------------------------------------


@query(over_bars("SELECT stream_id, bar, lp_label AS label FROM lp", Q.label_ctes("bars", 50, "lp")))
def label_pivots(spark, d):
    """Centred extremes of 50 bars to either side."""
    return labels.label_pivots(B.order_bars(spark, d), S, 50).select("stream_id", "bar", F.col("label").cast("int").alias("label"))


for _tag, _nest in (("", labels.NEST), ("_small", NEST)):
    def _structural(spark, d, nest=_nest):
        return labels.structural_pivots(B.order_bars(spark, d), S, nest).select("stream_id", "bar", F.col("label").cast("int").alias("label"))

    _structural.__doc__ = f"Labels that scales {_nest} agree on."
    query(over_bars("SELECT stream_id, bar, label FROM sp", Q.structural("bars", _nest, "sp")), f"structural_pivots{_tag}")(_structural)


# Detector and scores -----------------------------------------------------------------

for _side in ("high", "low"):
    _p = PRESET.side(_side)
    _det = Q.detector_ctes("bars", _side, _p, PRESET.baseline_lb, "det")

    def _candidates(spark, d, side=_side):
        c = detector.candidates(B.order_bars(spark, d), S, PRESET, (side,))
        return c.select("stream_id", "bar", *six(f"agree_{side}"), F.col(f"duration_{side}").alias("duration"), F.col(f"gate_{side}").alias("gate"), F.col(f"votes_{side}").alias("votes"), F.col(f"required_{side}").alias("required")).withColumnRenamed(f"agree_{side}", "agree")

    _candidates.__doc__ = f"Gates and votes of the {_side} side."
    query(over_bars("SELECT stream_id, bar, round(agree, 6) AS agree, dur AS duration, gate, votes, required FROM det", _det), f"detector_candidates_{_side}")(_candidates)

    def _signals(spark, d, side=_side):
        return detector.signals(B.order_bars(spark, d), S, PRESET, side)

    _signals.__doc__ = f"Signals of the {_side} side after cooldown."
    _sig = f"{_det},\n{Q.cooled_ctes('det', _p.cooldown_bars, 'sig')}"
    query(over_bars("SELECT stream_id, bar FROM sig", _sig), f"detector_signals_{_side}")(_signals)

    def _stats(spark, d, side=_side):
        b = labels.structural_pivots(B.order_bars(spark, d), S, NEST)
        marked = detector.detect(b, S, PRESET, (side,)).withColumnRenamed(f"signal_{side}", "signal")
        return marked

    def _match(spark, d, side=_side, marked=_stats):
        return scoring.match_stats(marked(spark, d, side), ["stream_id"], side, N).select("stream_id", "n_signals", "tp", "fp", "matched_pivots", "total_pivots", "n_bars", *six("precision"))

    _match.__doc__ = f"Signals of the {_side} side matched with labels."
    _mat = f"{Q.structural('bars', NEST, 'sp')},\n{_sig},\n{Q.match_ctes('sp', 'sig', _side, scoring.tolerance(N), 'mt')}"
    query(over_bars("SELECT stream_id, n_signals, tp, n_signals - tp AS fp, tp AS matched_pivots, total_pivots, n_bars, CASE WHEN n_signals > 0 THEN round(tp / n_signals, 6) ELSE 0.0 END AS precision FROM mt", _mat), f"signal_match_{_side}")(_match)

    def _score(spark, d, side=_side, marked=_stats):
        return scoring.side_score(marked(spark, d, side), ["stream_id"], side, {N: "label"}).select("stream_id", F.round("score", 9).alias("score"))

    _score.__doc__ = f"Score of the {_side} side."
    query(over_bars(f"SELECT stream_id, round({Q.score(N)}, 9) AS score FROM mt", _mat), f"side_score_{_side}")(_score)


# Folds -------------------------------------------------------------------------------

_WF = """wn AS (SELECT stream_id, count(*) AS n FROM bars GROUP BY stream_id),
wr AS (SELECT stream_id, n, greatest(round_even(0.20 * n, 0), 63)::BIGINT AS holdout, greatest(round_even(0.10 * n, 0), 252)::BIGINT AS inside, greatest(round_even(0.03 * n, 0), 63)::BIGINT AS outside, greatest(round_even(0.05 * n, 0), 63)::BIGINT AS step FROM wn WHERE n > 335),
wf AS (SELECT stream_id, inside, outside, i AS fold, i * step AS a FROM wr, range(0, 100) t(i) WHERE i * step + inside + 20 + outside <= n - holdout)"""


@query(over_bars("SELECT stream_id, fold, a AS is_start, a + inside AS is_end, a + inside + 20 AS oos_start, a + inside + 20 + outside AS oos_end FROM wf", _WF))
def walk_forward_folds(spark, d):
    """Walk-forward folds of every stream, in bars."""
    return folds.walk_forward_table(B.order_bars(spark, d))


@query(over_bars("SELECT stream_id, part, count(*) AS n_bars, min(bar) AS first_bar, max(bar) AS last_bar FROM (SELECT stream_id, bar, CASE WHEN bar < n - greatest(round_even(0.20 * n, 0), 63) THEN 'is' ELSE 'oos' END AS part FROM bars JOIN wn USING (stream_id)) GROUP BY ALL", _WF))
def holdout_split(spark, d):
    """The last fifth of each stream is held out."""
    return folds.holdout_split(B.order_bars(spark, d)).groupBy("stream_id", "part").agg(F.count(F.lit(1)).alias("n_bars"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


@query("SELECT i::INT AS block, (1000 * i // 5)::BIGINT AS test_start, (1000 * (i + 1) // 5)::BIGINT AS test_end, greatest(0, 1000 * i // 5 - 10)::BIGINT AS before, least(1000, 1000 * (i + 1) // 5 + 10)::BIGINT AS after FROM range(0, 5) t(i)")
def purged_folds(spark, d):
    """Blocks of a purged cross-validation."""
    return folds.purged_blocks(spark, 1000, 5, 10)


_CAL = f"""sp0 AS (SELECT stream_id, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY stream_id),
era AS (SELECT (SELECT lo FROM sp0 ORDER BY lo LIMIT 1 OFFSET 1) AS lo, (SELECT hi FROM sp0 ORDER BY hi DESC LIMIT 1 OFFSET 1) AS hi),
eb AS (SELECT bars.* FROM bars, era WHERE ts BETWEEN era.lo AND era.hi),
ref AS (SELECT stream_id FROM eb GROUP BY stream_id ORDER BY count(*) DESC, stream_id LIMIT 1),
ri AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM eb WHERE stream_id = (SELECT stream_id FROM ref)),
sz AS (SELECT any_value(n) AS n, greatest({PLAN.gate}, round_even(any_value(n) * 0.10, 0))::BIGINT AS ins, greatest({PLAN.gate}, round_even(any_value(n) * 0.03, 0))::BIGINT AS oos, greatest(1, round_even(any_value(n) * 0.05, 0))::BIGINT AS step, any_value(n) - round_even(any_value(n) * 0.20, 0)::BIGINT AS act FROM ri),
cf AS (SELECT k AS fold, k * step AS a, k * step + ins AS b, k * step + ins + {PLAN.embargo} AS c, k * step + ins + {PLAN.embargo} + oos AS e FROM sz, range(0, 200) t(k) WHERE k * step + ins + {PLAN.embargo} + oos <= act),
ce AS (SELECT fold, r1.ts AS is_start, r2.ts AS is_end, r3.ts AS oos_start, r4.ts AS oos_end FROM cf JOIN ri r1 ON r1.i = a JOIN ri r2 ON r2.i = b JOIN ri r3 ON r3.i = c JOIN ri r4 ON r4.i = e),
ch AS (SELECT fold, 'is' AS half, is_start AS lo, is_end AS hi FROM ce UNION ALL SELECT fold, 'oos', oos_start, oos_end FROM ce),
cs0 AS (SELECT ch.fold, ch.half, b.* EXCLUDE (bar), row_number() OVER (PARTITION BY ch.fold, ch.half, b.stream_id ORDER BY b.ts) - 1 AS bar, count(*) OVER (PARTITION BY ch.fold, ch.half, b.stream_id) AS n_ FROM lab b JOIN ch ON b.ts >= ch.lo AND b.ts < ch.hi),
cs1 AS (SELECT fold, stream_id FROM cs0 WHERE n_ >= {PLAN.gate} GROUP BY ALL HAVING count(DISTINCT half) = 2),
cs AS (SELECT cs0.* EXCLUDE (n_) FROM cs0 JOIN cs1 USING (fold, stream_id) WHERE n_ >= {PLAN.gate})"""
_CAL = f"{Q.structural('bars', NEST, 'lab')},\n{_CAL}"


def labelled_slices(spark: SparkSession, d: str) -> DataFrame:
    """Slices of calendar folds; labels are of the whole stream."""
    b = labels.structural_pivots(B.order_bars(spark, d), S, NEST)
    return folds.calendar_slices(b, folds.calendar_folds(b, PLAN), PLAN)


@query(over_bars("SELECT fold::INT AS fold, strftime(is_start, '%Y-%m-%d') AS is_start, strftime(is_end, '%Y-%m-%d') AS is_end, strftime(oos_start, '%Y-%m-%d') AS oos_start, strftime(oos_end, '%Y-%m-%d') AS oos_end FROM ce", _CAL))
def calendar_folds(spark, d):
    """Folds of the common era, by the reference stream's days."""
    f = folds.calendar_folds(B.order_bars(spark, d), PLAN)
    return f.select("fold", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("is_start", "is_end", "oos_start", "oos_end")))


@query(over_bars("SELECT fold::INT AS fold, stream_id, half, count(*) AS n_bars, sum(label)::BIGINT AS labels FROM cs GROUP BY ALL", _CAL))
def calendar_slices(spark, d):
    """Bars of each fold, stream and half."""
    return labelled_slices(spark, d).groupBy("fold", "stream_id", "half").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("label").alias("labels"))


@query(over_bars("SELECT side, count(*) AS n_folds, sum((n > 0)::INT)::BIGINT AS informative, round(avg(n), 6) AS mean_pivots FROM (SELECT 'high' AS side, fold, sum((label = 1)::INT) AS n FROM cs WHERE half = 'oos' GROUP BY fold UNION ALL SELECT 'low', fold, sum((label = -1)::INT) FROM cs WHERE half = 'oos' GROUP BY fold) GROUP BY side", _CAL))
def pool_diagnostic(spark, d):
    """Pivots that the outside halves hold."""
    return report.pool_diagnostic(labelled_slices(spark, d)).select("side", "n_folds", "informative", *six("mean_pivots"))


_KEYS = "fold, stream_id, half"
for _side in ("high", "low"):
    _p = PRESET.side(_side)
    _pool = f"""{_CAL},
{Q.detector_ctes('cs', _side, _p, PRESET.baseline_lb, 'det', _KEYS)},
{Q.cooled_ctes('det', _p.cooldown_bars, 'sig', _KEYS)},
{Q.match_ctes('cs', 'sig', _side, scoring.tolerance(N), 'mt', _KEYS)},
pw AS (SELECT fold, half, sum(w * n_signals) AS n_signals, sum(w * tp) AS tp, sum(w * total_pivots) AS total_pivots, sum(w * n_bars) AS n_bars FROM (SELECT *, CASE WHEN stream_id IN ('1-URGENT', '2-HIGH') THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM mt) GROUP BY ALL),
ps AS (SELECT *, {Q.score(N)} AS score FROM pw),
pf AS (SELECT fold, max(CASE WHEN half = 'is' THEN score END) AS is_score, max(CASE WHEN half = 'oos' THEN score END) AS oos_score, max(CASE WHEN half = 'oos' THEN total_pivots END) AS oos_pivots FROM ps GROUP BY fold)"""

    def _pooled(spark, d, side=_side):
        slices = labelled_slices(spark, d)
        feats = evaluate.features(slices, PRESET, side)
        return evaluate.score_candidates(feats, side, [(0, PRESET.side(side))], cluster_weights(spark, d), N)

    def _folds_scored(spark, d, side=_side, pooled=_pooled):
        f = pooled(spark, d, side)
        return f.select("fold", *(F.round(c, 9).alias(c) for c in ("is_score", "oos_score", "oos_pivots", "fold_score")))

    _folds_scored.__doc__ = f"Pooled scores of the {_side} side's folds."
    query(over_bars("SELECT fold::INT AS fold, round(is_score, 9) AS is_score, round(oos_score, 9) AS oos_score, round(oos_pivots, 9) AS oos_pivots, round(oos_score * exp(-2.0 * greatest(0.0, is_score - oos_score)), 9) AS fold_score FROM pf", _pool), f"pooled_scores_{_side}")(_folds_scored)


_SCORES = [0.10, 0.12, 0.11, 0.13, 0.09, 0.21, 0.05]
_DRAWS = ", ".join("[" + ",".join(map(str, r)) + "]" for r in scoring.bootstrap_indices(len(_SCORES)).tolist())


@query(f"""WITH d AS (SELECT unnest([{_DRAWS}]) AS idx), s AS (SELECT {_SCORES} AS v),
m AS (SELECT list_avg(list_transform(idx, lambda i: v[i + 1])) AS m FROM d, s)
SELECT 'a' AS study, {len(_SCORES)}::BIGINT AS n_folds, round((SELECT list_avg(v) FROM s), 9) AS mean_score, round(quantile_cont(m, 0.05), 9) AS lcb, round(quantile_cont(m, 0.95), 9) AS ucb FROM m
UNION ALL SELECT 'b', 1, 0.42, 0.42, 0.42""")
def bootstrap_bounds(spark, d):
    """Bounds of the mean of fold scores."""
    rows = [("a", i, s) for i, s in enumerate(_SCORES)] + [("b", 0, 0.42)]
    out = scoring.bootstrap_lcb(spark.createDataFrame(rows, "study string, fold int, fold_score double"), ["study"])
    return out.select("study", "n_folds", *(F.round(c, 9).alias(c) for c in ("mean_score", "lcb", "ucb")))


# Calibration -------------------------------------------------------------------------


_CP = "r AS (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS f, (o_orderpriority = '1-URGENT')::INT AS y FROM orders), v AS (SELECT f, sum(y) AS tp, count(*) AS n FROM r GROUP BY f)"


def _cut_sql(kind: str, leq: bool) -> str:
    w = f"OVER (ORDER BY f {'ASC' if leq else 'DESC'})"
    value = "1.25 * t / (c + 0.25 * pos)" if kind == "fbeta" else "t / pos - (c - t) / (total - pos)"
    return f"""WITH {_CP}, s AS (SELECT f, sum(tp) {w} AS t, sum(n) {w} AS c, sum(tp) OVER () AS pos, sum(n) OVER () AS total FROM v),
q AS (SELECT f::DOUBLE AS threshold, ({value})::DOUBLE AS score, t / c AS precision, t / pos AS recall, c::BIGINT AS n_predicted FROM s)
SELECT threshold, round(score, 9) AS score, round(precision, 9) AS precision, round(recall, 9) AS recall, n_predicted FROM q ORDER BY q.score DESC, n_predicted DESC LIMIT 1"""


for _kind, _leq in (("fbeta", False), ("fbeta", True), ("youden", False), ("youden", True)):
    def _cut(spark, d, kind=_kind, leq=_leq):
        o = spark.read.parquet(f"{d}/orders.parquet").select(F.round(F.col("o_totalprice") * 100).cast("long").alias("f"), (F.col("o_orderpriority") == "1-URGENT").alias("y"))
        b = calibrate.best_cutpoint(o, "f", "y", kind=kind, leq=leq)
        return b.select("threshold", *(F.round(c, 9).alias(c) for c in ("score", "precision", "recall")), "n_predicted")

    _cut.__doc__ = f"Best cut of order prices for urgent orders: {_kind}, {'at most' if _leq else 'at least'}."
    query(_cut_sql(_kind, _leq), f"cutpoint_{_kind}_{'leq' if _leq else 'geq'}")(_cut)


@query(f"""WITH RECURSIVE {Q.BARS}, r AS (SELECT stream_id, bar, close AS f, (close >= open) AS y, count(*) OVER (PARTITION BY stream_id) AS n FROM bars),
q AS (SELECT DISTINCT stream_id, unnest(qs) AS thr FROM (SELECT stream_id, quantile_cont(f::DOUBLE, [i / 255.0 for i in range(0, 256)]) AS qs FROM r GROUP BY stream_id)),
b AS (SELECT DISTINCT stream_id, i AS block, n * i // 5 AS lo, n * (i + 1) // 5 AS hi FROM r, range(0, 5) x(i)),
e AS (SELECT stream_id, block, thr, sum((f >= thr AND y)::INT) AS tp, sum((f >= thr)::INT) AS c, sum(y::INT) AS pos FROM r JOIN b USING (stream_id) JOIN q USING (stream_id) WHERE bar >= lo AND bar < hi GROUP BY ALL),
m AS (SELECT stream_id, thr, avg(CASE WHEN c + 0.25 * pos > 0 THEN 1.25 * tp / (c + 0.25 * pos) ELSE 0.0 END) AS s FROM e WHERE pos > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY round(s, 12) DESC, thr) AS i FROM m)
SELECT stream_id, round(thr, 6) AS threshold, round(s, 9) AS score FROM k WHERE i = 1""")
def cv_cutpoint(spark, d):
    """Cross-validated cut of closes for rising bars of every stream, with blocks over all its bars."""
    b = B.order_bars(spark, d).select("stream_id", "bar", F.col("close").alias("f"), (F.col("close") >= F.col("open")).alias("y"))
    return calibrate.cv_cutpoint(b, "f", "y", keys=["stream_id"]).select("stream_id", *six("threshold"), F.round("score", 9).alias("score"))


# Reports -----------------------------------------------------------------------------

_TRIALS = [("a", i, "PRUNED" if i % 7 == 3 else "COMPLETE", round(math.sin(i * 1.7) * 0.2 + 0.3, 6), (i * 37 % 11) / 10, (i * 13 % 17) / 16) for i in range(120)] + [("b", i, "COMPLETE", round(0.1 + i * 0.001, 6), i / 10, 1 - i / 10) for i in range(9)]
_TRIALS_SQL = "tr(study, trial, state, score, x, y) AS (VALUES " + ", ".join(f"('{a}', {b}::BIGINT, '{c}', {d!r}::DOUBLE, {x!r}::DOUBLE, {y!r}::DOUBLE)" for a, b, c, d, x, y in _TRIALS) + ")"


def _trials(spark):
    return spark.createDataFrame(_TRIALS, "study string, trial long, state string, score double, x double, y double")


@query(f"""WITH {_TRIALS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY score DESC, trial) AS rk FROM tr WHERE state = 'COMPLETE'),
a AS (SELECT study, count(*) AS n, max(score) AS best, min(CASE WHEN rk = 1 THEN trial END) AS bt, quantile_cont(score, 0.75) AS p75, stddev_pop(CASE WHEN rk <= 50 THEN score END) AS sd FROM c GROUP BY study)
SELECT tr.study, count(*) AS n_trials, any_value(n) AS n_complete, sum((state = 'PRUNED')::INT)::BIGINT AS n_pruned, any_value(bt) AS best_trial, round(any_value(best), 9) AS best, round(any_value(p75), 9) AS p75,
 round(any_value(best - sd * sqrt(2 * ln(n) / n)), 9) AS deflated FROM tr JOIN a USING (study) GROUP BY tr.study""")
def study_summary(spark, d):
    """Counts, best, quartile and deflated best of each study."""
    return optimize.study_summary(_trials(spark)).select("study", "n_trials", "n_complete", "n_pruned", "best_trial", *(F.round(c, 9).alias(c) for c in ("best", "p75", "deflated")))


@query(f"""WITH {_TRIALS_SQL}, g AS (SELECT study AS kind, count(*) AS n, avg(score) AS mean, quantile_cont(score, 0.75) AS p75, stddev_pop(score) AS std, avg((score >= 0.45)::INT) AS near_share FROM tr GROUP BY study)
SELECT kind, n, round(mean, 9) AS mean, round(p75, 9) AS p75, round(std, 9) AS std, round(near_share, 9) AS near_share, round(mean / 0.5, 9) AS ratio,
 CASE WHEN near_share >= 0.2 AND mean / 0.5 >= 0.6 THEN 'stable' WHEN near_share >= 0.08 AND mean / 0.5 >= 0.35 THEN 'moderate' ELSE 'outlier' END AS verdict FROM g""")
def stability_summary(spark, d):
    """How scores near a best one hold up."""
    out = optimize.stability(_trials(spark).select(F.col("study").alias("kind"), "score"), 0.5)
    return out.select("kind", "n", *(F.round(c, 9).alias(c) for c in ("mean", "p75", "std", "near_share", "ratio")), "verdict")


@query(f"WITH {_TRIALS_SQL} SELECT 'x' AS name, round(corr(x, score), 9) AS r FROM tr UNION ALL SELECT 'y', round(corr(y, score), 9) FROM tr")
def sensitivity(spark, d):
    """Correlation of parameters with the score."""
    return optimize.sensitivity(_trials(spark), ["x", "y"]).select("name", F.round("r", 9).alias("r"))


@query(None)
def parameter_map(spark, d):
    """Trials in the plane of two principal components."""
    return optimize.parameter_map(_trials(spark), ["x", "y", "score"]).select("study", "trial", *six("pc1", "pc2"))


@query(over_bars(f"SELECT 'label50' AS \"column\", count(*) AS n_compared, sum((a.lp_label <> b.lq_label)::INT)::BIGINT AS n_mismatch, round(avg((a.lp_label <> b.lq_label)::INT), 9) AS rate, max(abs(a.lp_label - b.lq_label))::DOUBLE AS max_abs_diff FROM lp a JOIN lq b USING (stream_id, bar)", f"{Q.label_ctes('bars', 50, 'lp')}, {Q.label_ctes('bars', 40, 'lq')}"))
def parity(spark, d):
    """Two frames compared column by column."""
    b = B.order_bars(spark, d)
    ours = labels.label_pivots(b, S, 50, "label50").select("stream_id", "bar", "label50")
    theirs = labels.label_pivots(b, S, 40, "label50").select("stream_id", "bar", "label50")
    return report.parity(ours, theirs, ["label50"], ("stream_id", "bar")).withColumn("rate", F.round("rate", 9))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{report.constant(v)}')" for k, v in PRESETS["default"].to_dict().items()) + ") t(name, value)")
def chart_constants(spark, d):
    """Default parameters as a chart script writes them."""
    return report.constant_rows(spark, PRESETS["default"])


@query(None)
def coordinate_ascent(spark, d):
    """Trace of a short ascent over two thresholds on the pooled folds."""
    slices = labelled_slices(spark, d).persist()
    score = optimize.pooled_scorer(slices, PRESET, "low", cluster_weights(spark, d), N)
    result = optimize.ascend(PRESET.side("low"), "low", score, sweeps=1, grid_n=3, fields=["min_agreement", "scale_div_thresh"])
    score.close()
    slices.unpersist()
    return optimize.trace_frame(spark, result)


@query(None)
def detector_default(spark, d):
    """Signals and pivots of the default parameters, 90 scales on the high side."""
    return detector.detect(B.order_bars(spark, d), S, PRESETS["default"]).select("stream_id", "bar", "signal_high", "signal_low", "baseline_high", "baseline_low")


@query(None)
def detector_all_votes(spark, d):
    """Signals with every vote, gate and edge voting switched on."""
    on = dict(use_trend=True, use_volume=True, use_momentum=True, use_volatility=True, use_er_gate=True, use_gjr_asym=True, use_har_vol=True, use_edge_voting=True, vola_range_len=20)
    params = replace(PRESET, high=replace(PRESET.high, **on), low=replace(PRESET.low, **on))
    return detector.detect(B.order_bars(spark, d), S, params).select("stream_id", "bar", "signal_high", "signal_low")


@query(None)
def stability_probe(spark, d):
    """Lower bounds of draws near the thresholds of the LOW side, on the pooled folds."""
    slices = labelled_slices(spark, d).persist()
    score = optimize.pooled_scorer(slices, PRESET, "low", cluster_weights(spark, d), N)
    at = PRESET.low
    drawn = [replace(at, min_agreement=at.min_agreement + i * 0.05, scale_div_thresh=at.scale_div_thresh - i * 0.05) for i in range(4)]
    rows = [("local", float(s)) for s in score(drawn)]
    score.close()
    slices.unpersist()
    return optimize.stability(spark.createDataFrame(rows, "kind string, score double"), max(s for _, s in rows) or 1.0)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Flagship: daily bars through features, gates and votes to signals of both sides."""
    return detector.detect(B.order_bars(spark, sf_dir), S, PRESET)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import runs  # noqa: F401  registers whole runs

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import runs  # noqa: F401

    return dict(_sql)
