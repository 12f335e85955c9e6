"""Independent SQL for the oracle: each helper returns text for DuckDB."""

from __future__ import annotations

import math

from ..plans.params import SideParams

BARS = """ticks AS (SELECT o_orderpriority AS stream_id, o_orderdate::TIMESTAMP AS ts, o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS px0 FROM orders),
walk AS (SELECT stream_id, ts, key, 500000000 + CAST(sum(px0 - 25000000) OVER (PARTITION BY stream_id ORDER BY ts, key) AS BIGINT) // 5 AS px FROM ticks),
daily AS (SELECT stream_id, date_trunc('day', ts) AS ts, first(px ORDER BY ts, key) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, key) AS close, CAST(count(*) * 100000 AS BIGINT) AS volume
          FROM walk GROUP BY ALL),
bars AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts) - 1 AS bar FROM daily)"""

K = "stream_id"


def over(keys: str = K, n: int | None = None, ahead: int | None = None, frame: str | None = None) -> str:
    if n is not None:
        frame = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY {keys} ORDER BY bar{' ' + frame if frame else ''})"


def full(agg: str, col: str, n: int, keys: str = K) -> str:
    w = over(keys, n)
    return f"(CASE WHEN count({col}) {w} = {n} THEN {agg}({col}) {w} END)"


def pir(col: str, n: int, keys: str = K) -> str:
    lo, hi = full("min", col, n, keys), full("max", col, n, keys)
    return f"(CASE WHEN {hi} = {lo} THEN 0.5 ELSE ({col} - {lo}) / CASE WHEN {hi} - {lo} < 1e-10 THEN 1e-10 ELSE {hi} - {lo} END END)"


def lag(col: str, n: int = 1, keys: str = K) -> str:
    return f"lag({col}, {n}) {over(keys)}"


def extreme(col: str, n: int, high: bool, keys: str = K) -> str:
    w = over(keys, frame=f"ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING")
    return f"coalesce(count({col}) {w} = {2 * n + 1} AND {col} = {'max' if high else 'min'}({col}) {w}, false)"


def gate(col: str, n: int, high: bool, keys: str = K) -> str:
    w = over(keys, frame=f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")
    return f"coalesce(count({col}) {w} = {n} AND {col} {'>=' if high else '<='} {'max' if high else 'min'}({col}) {w}, false)"


def label_ctes(src: str, n: int, out: str, keys: str = K) -> str:
    return f"""{out}_r AS (SELECT *, CASE WHEN {extreme('high', n, True, keys)} AND NOT {extreme('low', n, False, keys)} THEN 1
   WHEN {extreme('low', n, False, keys)} AND NOT {extreme('high', n, True, keys)} THEN -1 ELSE 0 END AS raw_ FROM {src}),
{out}_c AS (SELECT *, CASE WHEN raw_ IS DISTINCT FROM {lag('raw_', 1, keys)} THEN 1 ELSE 0 END AS ch_ FROM {out}_r),
{out}_g AS (SELECT *, sum(ch_) {over(keys)} AS run_ FROM {out}_c),
{out} AS (SELECT * EXCLUDE (raw_, ch_, run_), CASE WHEN row_number() OVER (PARTITION BY {keys}, run_ ORDER BY bar) % 2 = 1 THEN raw_ ELSE 0 END AS {out}_label FROM {out}_g)"""


def structural(src: str, nest: tuple[int, ...], out: str, keys: str = K) -> str:
    parts, now = [], src
    for n in nest:
        parts.append(label_ctes(now, n, f"{out}{n}", keys))
        now = f"{out}{n}"
    names = [f"{out}{n}_label" for n in nest]
    same = " AND ".join(f"{a} = {names[0]}" for a in names[1:]) or "true"
    parts.append(f"{out} AS (SELECT * EXCLUDE ({', '.join(names)}), CASE WHEN {same} THEN {names[0]} ELSE 0 END AS label FROM {now})")
    return ",\n".join(parts)


def agreement_ctes(src: str, scales: list[int], sides: dict[str, tuple[bool, float]], out: str, keys: str = K) -> str:
    sma = ", ".join(f"close / {full('avg', 'close', k, keys)} AS rel{k}" for k in scales)
    pos = ", ".join(f"CAST({pir(f'rel{k}', max(k, 20), keys)} AS FLOAT) AS p{k}" for k in scales)
    shares = []
    for name, (high, pct) in sides.items():
        limit = f"CAST({pct if high else 1.0 - pct!r} AS FLOAT)"
        hits = " + ".join(f"coalesce(CAST(p{k} {'>' if high else '<'} {limit} AS INT), 0)" for k in scales)
        shares.append(f"({hits}) / {float(len(scales))} AS {name}")
    drop = ", ".join([f"rel{k}" for k in scales] + [f"p{k}" for k in scales])
    return f"""{out}_a AS (SELECT *, {sma} FROM {src}),
{out}_b AS (SELECT *, {pos} FROM {out}_a),
{out} AS (SELECT * EXCLUDE ({drop}), {', '.join(shares)} FROM {out}_b)"""


def drift_ctes(src: str, m: int, lb: int, out: str, keys: str = K) -> str:
    """Baseline pivots known lb bars late, and the drift over the last m of them."""
    k = [x.strip() for x in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    return f"""{out}_p AS (SELECT *, CASE WHEN {extreme('high', lb, True, keys)} THEN high END AS ph_, CASE WHEN {extreme('low', lb, False, keys)} THEN low END AS pl_ FROM {src}),
{out}_k AS (SELECT * EXCLUDE (ph_, pl_), {lag('ph_', lb, keys)} AS baseline_high, {lag('pl_', lb, keys)} AS baseline_low FROM {out}_p),
{out}_e AS (SELECT {keys}, bar, 0 AS o, baseline_high AS v FROM {out}_k WHERE baseline_high IS NOT NULL UNION ALL SELECT {keys}, bar, 1, baseline_low FROM {out}_k WHERE baseline_low IS NOT NULL),
{out}_n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bar, o) AS i FROM {out}_e),
{out}_s AS (SELECT *, coalesce(sum((baseline_high IS NOT NULL)::INT + (baseline_low IS NOT NULL)::INT) {over(keys, frame='ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0) AS seen_ FROM {out}_k),
{out} AS (SELECT s.* EXCLUDE (seen_), CASE WHEN seen_ >= {m} THEN (b.v - a.v) / greatest(abs(a.v), 1e-9) / {float(m - 1)} ELSE 0.0 END AS drift
  FROM {out}_s s LEFT JOIN {out}_n a ON {on('a', 's')} AND a.i = s.seen_ - {m - 1} LEFT JOIN {out}_n b ON {on('b', 's')} AND b.i = s.seen_)"""


def duration_ctes(src: str, hit: str, out: str, keys: str = K) -> str:
    return f"""{out}_h AS (SELECT *, coalesce({hit}, false) AS hit_ FROM {src}),
{out}_m AS (SELECT *, CASE WHEN NOT hit_ AND NOT coalesce({lag('hit_', 1, keys)}, true) THEN 1 ELSE 0 END AS reset_ FROM {out}_h),
{out}_g AS (SELECT *, sum(reset_) {over(keys)} AS island_ FROM {out}_m),
{out} AS (SELECT * EXCLUDE (hit_, reset_, island_), CAST(sum(hit_::INT) OVER (PARTITION BY {keys}, island_ ORDER BY bar) AS BIGINT) AS dur FROM {out}_g)"""


def detector_ctes(src: str, side: str, p: SideParams, lb: int, out: str, keys: str = K) -> str:
    """Candidates of a side, for presets whose votes are drift and momentum velocity."""
    high = side == "high"
    scales = list(range(p.scale_start, p.scale_end + 1, p.scale_step))
    n = p.S_detect
    ret = f"(close - {lag('close', n, keys)}) / CAST({lag('close', n, keys)} AS DOUBLE)"
    t = abs(p.momentum_velocity_thresh)
    falls = high == (p.momentum_velocity_mode == "Reversal")
    vote = f"velocity <= {-t!r}" if falls else f"velocity >= {t!r}"
    drift_vote = f"drift < {-p.pivot_drift_thresh!r}" if high else f"drift > {p.pivot_drift_thresh!r}"
    position = "position" if high else "1.0 - position"
    most = max(sum((p.use_momentum_velocity,)), 1)
    bias = f"CASE WHEN drift > {p.pivot_drift_thresh!r} THEN {p.pivot_drift_confirm_bias} ELSE 0 END"
    blocked = f" AND NOT drift > {p.pivot_drift_thresh * p.pivot_drift_gate_mult!r}" if high else ""
    return f"""{drift_ctes(src, max(p.pivot_drift_lookback, 2), lb, out + '_d', keys)},
{agreement_ctes(out + '_d', scales, {'agree': (high, p.pct_extreme)}, out + '_ag', keys)},
{out}_f1 AS (SELECT *, close / {full('avg', 'close', n, keys)} AS rel_, {ret} AS ret_ FROM {out}_ag),
{out}_f2 AS (SELECT *, {pir('rel_', max(n, 20), keys)} AS position, ret_ - {lag('ret_', 1, keys)} AS velocity, {gate('high' if high else 'low', p.price_gate_lb, high, keys)} AS reached FROM {out}_f1),
{duration_ctes(out + '_f2', f'agree > {p.dur_extreme_pct!r}', out + '_du', keys)},
{out} AS (SELECT *, reached AND agree >= {p.min_agreement!r} AND dur >= {p.min_duration} AND NOT coalesce(abs({position} - agree) > {p.scale_div_thresh!r}, false){blocked} AS gate,
  coalesce(({drift_vote})::INT, 0) + coalesce(({vote})::INT, 0) AS votes,
  greatest(least({p.confirm_count} {'+' if high else '-'} {bias}, {most}), 1) AS required FROM {out}_du)"""


def cooled_ctes(src: str, cooldown: int, out: str, keys: str = K) -> str:
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"n.{x} = a.{x}" for x in k)
    return f"""{out}_n AS (SELECT {keys}, bar, min(bar) OVER (PARTITION BY {keys} ORDER BY bar RANGE BETWEEN {cooldown + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {src} WHERE gate AND votes >= required),
{out} AS (SELECT {keys}, min(bar) AS bar FROM {out}_n GROUP BY {keys} UNION ALL SELECT {', '.join('a.' + x for x in k)}, n.nxt AS bar FROM {out} a JOIN {out}_n n ON {on} AND n.bar = a.bar WHERE n.nxt IS NOT NULL)"""


def match_ctes(labels: str, signals: str, side: str, cap: int, out: str, keys: str = K) -> str:
    """Greedy matching by recursion over signals, and the counts."""
    k = [x.strip() for x in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    m = ", ".join("m." + x for x in k)
    sign = 1 if side == "high" else -1
    return f"""{out}_s AS (SELECT {keys}, bar, row_number() OVER (PARTITION BY {keys} ORDER BY bar) AS i FROM {signals}),
{out}_v AS (SELECT {keys}, bar FROM {labels} WHERE label = {sign}),
{out}_m AS (SELECT DISTINCT {keys}, 0::BIGINT AS i, -1::BIGINT AS last_, 0::BIGINT AS tp FROM {out}_s
  UNION ALL SELECT {m}, m.i + 1, coalesce(min(v.bar), m.last_)::BIGINT, (m.tp + (min(v.bar) IS NOT NULL)::INT)::BIGINT
  FROM {out}_m m JOIN {out}_s s ON {on('s', 'm')} AND s.i = m.i + 1 LEFT JOIN {out}_v v ON {on('v', 'm')} AND v.bar > m.last_ AND v.bar BETWEEN s.bar - 2 AND s.bar + {cap}
  GROUP BY {m}, m.i, m.last_, m.tp),
{out}_t AS (SELECT {keys}, max(tp) AS tp, max(i) AS n_signals FROM {out}_m GROUP BY {keys}),
{out} AS (SELECT {', '.join('b.' + x for x in k)}, coalesce(any_value(t.n_signals), 0)::BIGINT AS n_signals, coalesce(any_value(t.tp), 0)::BIGINT AS tp, sum((b.label = {sign})::INT)::BIGINT AS total_pivots, count(*)::BIGINT AS n_bars
  FROM {labels} b LEFT JOIN {out}_t t ON {on('t', 'b')} GROUP BY {', '.join('b.' + x for x in k)})"""


def score(n: int, c: str = "") -> str:
    target = 0.4 * math.sqrt(100 / n)
    return f"""CASE WHEN {c}n_signals > 0 AND {c}tp > 0 AND {c}total_pivots > 0 THEN pow({c}tp / {c}n_signals, 1.2) * (1 - exp(-({c}tp / {c}total_pivots) / {target!r})) * least(1.0, {c}n_signals / {c}n_bars / 0.001)
  * 2 * greatest({c}n_signals, 1.0) * greatest({c}total_pivots, 1.0) / (greatest({c}n_signals, 1.0) * greatest({c}n_signals, 1.0) + greatest({c}total_pivots, 1.0) * greatest({c}total_pivots, 1.0)) ELSE 0.0 END"""
