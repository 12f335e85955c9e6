"""Quality by weak supervision, in DataFrame functions only.

Rules vote good, vote bad or abstain.  Expectation-maximisation estimates how accurate
each rule is on good and on bad documents from the agreement of the votes alone, and a
document is kept by its posterior probability of being good, not by passing all rules.
The votes of the corpus are counted by pattern; the pattern table, at most 3 to the
power of the number of rules whatever the corpus, is all that the driver sees.

Defined cases: a null or empty text has no words, so all its counts are 0 and the base
rule fails it; texts of any length are read whole; repeated rows get the same verdict
each; an empty table gives no rows; extra columns play no part, and the columns that
are made replace any of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .store import cut

#: White space that ends words.
WHITE = " \t\n\x0b\x0c\r"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that are found twice or more in the text, the first included."""
    windows = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def any_twice(hashes: Column) -> Column:
        following = F.concat(F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))), F.array(F.lit(None).cast("long")))
        return F.exists(F.zip_with(hashes, following, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)

    def covered(placed: Column) -> Column:
        none = F.lit(None).cast("struct<x:bigint,i:int>")
        n = F.size(placed)
        following = F.concat(F.slice(placed, 2, n), F.array(none))
        before = F.concat(F.array(none), F.slice(placed, 1, n - 1))
        with_next = F.zip_with(placed, following, lambda a, b: F.struct(a["x"].alias("x"), a["i"].alias("i"), F.coalesce(a["x"] == b["x"], F.lit(False)).alias("t")))
        flagged = F.zip_with(with_next, before, lambda a, b: F.when(a["t"] | F.coalesce(a["x"] == b["x"], F.lit(False)), a["i"]))
        at = F.sort_array(F.filter(flagged, lambda i: i.isNotNull()))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, zero, lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n")), lambda s: s["n"])

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(_let(F.sort_array(hashes), any_twice), _let(placed, covered)).otherwise(F.lit(0))

    return _let(windows, count)


def text_counts(text: Column) -> dict[str, Column]:
    """Counts of a whole text, by name."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(F.translate(t, WHITE, " " * len(WHITE)), " ", -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: F.substring(F.rtrim(y), -1, 1).isin(".", "!", "?", '"', ":", ";", ","))).cast("long").alias("n_ended_lines"),
    ))
    return {
        "of_words": of_words,
        "of_lines": of_lines,
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_capitals": (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_shouts": (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long"),
    }


def votes() -> dict[str, Column]:
    """Each rule's vote, 1 good, -1 bad, 0 abstains, over the columns of counts (``n_words`` > 0).

    Most rules know one defect and abstain where they don't see it.
    """
    n, c = F.col("n_words"), F.col

    def bad(seen: Column) -> Column:
        return F.when(seen, -1).otherwise(0)

    regular = (c("word_chars") >= 3 * n) & (c("word_chars") <= 9 * n) & (c("n_symbols") * 50 <= n) & (c("n_dup_lines") == 0)
    regular = regular & (c("n_repeat_words") * 50 <= n) & (c("n_capitals") * 5 <= c("word_chars")) & (c("n_shouts") * 20 <= n)
    return {
        "regular": F.when(regular, 1).otherwise(0),
        "prose": F.when(c("n_ended_lines") * 2 >= c("n_lines"), 1).when(c("n_ended_lines") * 10 < c("n_lines"), -1).otherwise(0),
        "short": bad(n < 15),
        "word_length": bad((c("word_chars") < 2.5 * n) | (c("word_chars") > 12 * n)),
        "symbols": bad(c("n_symbols") * 10 > n),
        "many_symbols": bad(c("n_symbols") * 10 > 3 * n),
        "dup_lines": bad(c("n_dup_lines") * 10 > 3 * c("n_lines")),
        "repeats": bad(c("n_repeat_words") * 10 > n),
        "capitals": bad(c("n_capitals") * 10 > 3 * c("word_chars")),
        "shouts": bad(c("n_shouts") * 10 > n),
    }


#: Where expectation-maximisation starts: P(bad vote), P(abstains), P(good vote) of a rule on bad and on good documents.
START = {False: (0.30, 0.60, 0.10), True: (0.02, 0.48, 0.50)}
#: Share of the documents that the start counts as, so that the two classes keep their meaning.
START_WEIGHT = 0.02

Rates = list[dict[bool, tuple[float, float, float]]]


def fit_accuracies(patterns: list[tuple[tuple[int, ...], int]], *, rounds: int = 200, prior: float = 0.85) -> tuple[float, Rates]:
    """(share of good, P(vote | class) of each rule) by expectation-maximisation over counted vote patterns.

    An abstention is an outcome like the votes, for a rule that only ever votes bad says
    something by abstaining.
    """
    if not patterns:
        return prior, []
    m, total = len(patterns[0][0]), sum(n for _, n in patterns)
    good, rates = prior, [dict(START) for _ in range(m)]
    for _ in range(rounds):
        weight = START_WEIGHT * total
        counts = [{k: [weight * x for x in START[k]] for k in START} for _ in range(m)]
        all_good = weight * prior
        for pattern, n in patterns:
            p = posterior(pattern, good, rates)
            all_good += n * p
            for k, v in enumerate(pattern):
                counts[k][True][v + 1] += n * p
                counts[k][False][v + 1] += n * (1 - p)
        new = all_good / (total + weight)
        fitted = [{k: tuple(x / sum(c[k]) for x in c[k]) for k in c} for c in counts]
        moved = max(abs(new - good), *(abs(x - y) for r, s in zip(fitted, rates, strict=True) for k in r for x, y in zip(r[k], s[k], strict=True)))
        good, rates = new, fitted
        if moved < 1e-9:
            break
    return good, rates


def log_odds(vote: int, rate: dict[bool, tuple[float, float, float]]) -> float:
    """What a vote adds to the log odds of good."""
    return math.log(max(rate[True][vote + 1], 1e-9) / max(rate[False][vote + 1], 1e-9))


def posterior(pattern: tuple[int, ...], good: float, rates: Rates) -> float:
    z = math.log(good / (1 - good)) + sum(log_odds(v, r) for v, r in zip(pattern, rates, strict=True))
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, votes' posterior, base_failed, kept) of each row."""
    counts = text_counts(F.col(text_col))
    read = docs.select(F.col(id_col).alias("__id"), *(v.alias(k) for k, v in counts.items()))
    flat = cut(read.select("__id", "of_words.*", "of_lines.*", "word_chars", "n_symbols", "n_capitals", "n_shouts"), "quality-counts")
    rules = votes()
    voted = flat.where("n_words > 0").select(*(v.alias(k) for k, v in rules.items()))
    patterns = sorted((tuple(r[k] for k in rules), r["n"]) for r in voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).collect())
    good, rates = fit_accuracies(patterns)
    z = F.lit(math.log(good / (1 - good)))
    for rule, rate in zip(rules.values(), rates, strict=False):
        z = z + F.when(rule == 1, F.lit(log_odds(1, rate))).when(rule == -1, F.lit(log_odds(-1, rate))).otherwise(F.lit(log_odds(0, rate)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    probability = F.when(F.col("n_words") > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))
    return flat.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (probability >= 0.5)).alias("kept"), probability.alias("posterior"),
    )
