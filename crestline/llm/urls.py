"""URL filters: rules on hosts and paths, and a character language-model ratio for the rest.

The longest rule that fits decides.  The urls it decides teach two character models,
one of accepted and one of rejected urls: variable-order Markov models up to
``ORDER`` characters of context, each order smoothed by the one below (Witten and
Bell's weights, a uniform distribution at the end).  A url is scored by the difference
of the two log-likelihoods for each character; a logistic calibration on ruled urls that
were not learnt from (a fifth, by hash) turns the score into a probability, and the url
is allowed at 0.5 or more.

Only distinct windows of ``ORDER + 1`` characters are looked up, so a host that most
urls share costs what one url costs; their scores go back to the urls by a join that
is broadcast up to ``BROADCAST_WINDOWS`` rows and shuffled beyond.  The driver sees a
histogram of calibration scores, bounded by its bins.  All in DataFrame functions.

Rules look at host and path; the models read the whole url, with its scheme, query and
fragment, as it is but for A-Z of the host, which are lower-cased.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no
rule; a null url is an empty text for the models, scored by its end alone; without both
accepted and rejected urls the verdict is allow; repeated rows are judged each; an empty
table gives no rows; urls of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .store import cut

ORDER = 5
BROADCAST_WINDOWS = 200_000
#: Probability of a character that was never seen.
UNSEEN = 1.0 / 4096
_PAD, _END = "\x02", "\x03"
_BIN = 0.02


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?`` or ``#``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def whole_url(url: Column) -> Column:
    """The url as the models read it: all of it, the host's A-Z lower-cased; empty for null."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    host, _ = split_url(url)
    rest = F.substring(u, at + 3 + F.length(host), F.length(u))
    return F.when(at > 0, F.concat(F.substring(u, F.lit(1), at + 2), host, rest)).otherwise(u)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null; the rules are a parameter, not data."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.array(*(F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules))
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))


def _windows(text: Column) -> Column:
    """Each character of a text and its end, with the ORDER characters before it."""
    chars = F.filter(F.split(F.concat(F.lit(_PAD * ORDER), text, F.lit(_END)), ""), lambda c: c != "")
    return F.transform(F.array(chars), lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - ORDER), lambda i: F.array_join(F.slice(a, i, ORDER + 1), "")))[0]


def _orders(window: Column) -> Column:
    """(order, context, character) of a window, for each order."""
    last = F.substring(window, ORDER + 1, 1)
    return F.array(*(F.struct(F.lit(k).alias("k"), F.substring(window, ORDER + 1 - k, k).alias("ctx"), last.alias("c")) for k in range(ORDER + 1)))


def fit_windows(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of (k, ctx, c) and of (k, ctx) in accepted and rejected urls, from rows (window, accepted, n)."""
    exploded = windows.select("accepted", "n", F.explode(_orders(F.col("window"))).alias("o")).select("accepted", "n", "o.*")
    yes = F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0))
    no = F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n")))
    counts = cut(exploded.groupBy("k", "ctx", "c").agg(yes.alias("a"), no.alias("r")), "url-counts")
    kinds = [F.sum((F.col(x) > 0).cast("long")).alias(f"kinds_{x}") for x in "ar"]
    return counts, cut(counts.groupBy("k", "ctx").agg(F.sum("a").alias("all_a"), F.sum("r").alias("all_r"), *kinds), "url-contexts")


def score_windows(distinct: DataFrame, counts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(window, ratio): log of the probability when accepted over that when rejected."""
    rows = distinct.select("window", F.explode(_orders(F.col("window"))).alias("o")).select("window", "o.*")
    seen = rows.join(counts, ["k", "ctx", "c"], "left").join(contexts, ["k", "ctx"], "left")
    fields = ("a", "r", "all_a", "all_r", "kinds_a", "kinds_r")
    step = F.struct("k", *(F.coalesce(F.col(f), F.lit(0)).cast("double").alias(f) for f in fields))
    ordered = seen.groupBy("window").agg(F.sort_array(F.collect_list(step)).alias("steps"))

    def chance(x: str) -> Column:
        def up(p: Column, s: Column) -> Column:
            weight = s[f"all_{x}"] + s[f"kinds_{x}"]
            return F.when(weight > 0, (s[x] + s[f"kinds_{x}"] * p) / F.when(weight > 0, weight)).otherwise(p)

        return F.aggregate("steps", F.lit(UNSEEN), up)

    return ordered.select("window", (F.ln(chance("a")) - F.ln(chance("r"))).alias("ratio"))


def calibrate(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """(slope, offset) of a logistic fit over (bin, accepted, rejected), both classes weighing the same."""
    yes, no = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not yes or not no:
        return 1.0, 0.0
    data = [(b * _BIN, a / yes, r / no) for b, a, r in bins]
    slope, offset = 1.0, 0.0
    for _ in range(100):
        g0 = g1 = 0.0
        h00 = h01 = h11 = 1e-4
        h01 = 0.0
        g0 -= 1e-4 * slope
        for x, a, r in data:
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, slope * x + offset))))
            d, v = a * (1 - p) - r * p, (a + r) * p * (1 - p)
            g0, g1 = g0 + d * x, g1 + d
            h00, h01, h11 = h00 + v * x * x, h01 + v * x, h11 + v
        det = h00 * h11 - h01 * h01
        d0, d1 = (g0 * h11 - g1 * h01) / det, (g1 * h00 - g0 * h01) / det
        size = max(abs(d0), abs(d1))
        scale = min(1.0, 5.0 / size) if size else 1.0
        slope, offset = slope + scale * d0, offset + scale * d1
        if size < 1e-9:
            break
    return slope, offset


def filter_urls(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, host, path, rule, verdict, score, probability) of each row; score and probability are of the models.

    The scores of up to ``broadcast_windows`` distinct windows are broadcast; more are joined by a shuffle.
    """
    host, path = split_url(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"), whole_url(F.col(url_col)).alias("__text"))
    parsed = parsed.withColumn("__best", best_rule(F.col("host"), F.col("path"), rules))
    parsed = parsed.select(F.monotonically_increasing_id().alias("row"), "__id", "host", "path", "__text", F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("by_rule"))
    parsed = cut(parsed, "urls")
    text = F.col("__text")
    learnt = F.col("by_rule").isNotNull() & (F.pmod(F.xxhash64("host", "path"), F.lit(5)) != 0)
    use = F.when(learnt, "learn").when(F.col("by_rule").isNotNull(), "calibrate").otherwise("judge").alias("use")
    placed = parsed.select("row", use, (F.col("by_rule") == "allow").alias("accepted"), F.explode(_windows(text)).alias("window"))
    counted = cut(placed.groupBy("window", "use", "accepted").agg(F.count(F.lit(1)).alias("n")), "url-windows")
    counts, contexts = fit_windows(counted.where("use = 'learn'"))
    ratios = cut(score_windows(counted.select("window").distinct(), counts, contexts), "url-ratios")
    few = ratios.limit(broadcast_windows + 1).count() <= broadcast_windows
    scored = placed.join(F.broadcast(ratios) if few else ratios.hint("merge"), "window")
    scores = cut(scored.groupBy("row").agg(F.avg("ratio").alias("score"), F.first("use").alias("use"), F.first("accepted").alias("accepted")), "url-scores")
    hold = scores.where("use = 'calibrate'").groupBy(F.round(F.col("score") / _BIN).cast("int").alias("bin")).agg(F.sum(F.col("accepted").cast("int")).alias("a"), F.sum((~F.col("accepted")).cast("int")).alias("r"))
    slope, offset = calibrate(sorted((b["bin"], b["a"], b["r"]) for b in hold.collect()))
    both = scores.where("use = 'learn'").agg(F.min("accepted"), F.max("accepted")).first()
    probability = 1 / (1 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(offset))))
    by_model = F.when(probability >= 0.5, "allow").otherwise("block") if both[0] is False and both[1] is True else F.lit("allow")
    return parsed.join(scores.select("row", "score"), "row").select(
        F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score", probability.alias("probability")
    )
