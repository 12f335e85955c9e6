"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate, ``weight * total / size`` in characters, so
that the expected share of each source is its target weight.  A document's number of
copies is the inverse of the Poisson distribution with that mean, at a uniform value
taken from a hash of seed, id and text; copies are exploded and dealt out by another
hash of id, text and copy, which shuffles them globally.  A run is repeatable and needs no state.

Defined cases: a null source is a source of its own (the weights' key for it is None,
written as an empty string in its table); a source without a weight has weight 0 and
goes; weights are normalised over the sources that are present; null or empty texts
count one character, so that no rate is infinite; two equal rows get equal numbers of copies and stay two;
an empty table gives no rows.  Extra columns are carried through; internal columns
have a prefix that no table uses, so names do not clash.

Where no rows may be lost to a rate below one, pass ``floor``: the rate is then
that at least.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: A table of sources up to so many rows is broadcast; beyond, it is joined by a shuffle that splits hot sources.
BROADCAST_SOURCES = 50_000
#: Largest rate of one draw.
MOST_RATE = 500
#: The inverse is searched to this many standard deviations above the mean.
_TAIL = 12


def uniform(seed: int, *cols: Column) -> Column:
    """A value in (0, 1) from 52 bits of an MD5 hash."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_inverse(u: Column, rate: Column) -> Column:
    """Smallest k whose cumulated Poisson probability reaches u.

    The sum runs over as many terms as the rate asks for.  Above MOST_RATE exp(-rate)
    nears the end of the doubles, and ``poisson_copies`` adds up several draws.
    """
    last = F.ceil(rate + _TAIL * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.when(u > F.exp(-rate), 1).otherwise(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (s["k"] + F.when(u > c, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def poisson_copies(seed: int, rate: Column, *key: Column) -> Column:
    """A Poisson draw of each row, from a hash of seed and key.

    A rate above MOST_RATE is cut into equal rates below it; the draws of the parts, from
    hashes of their own, add up to a Poisson draw of the whole.
    """
    parts = F.greatest(F.ceil(rate / MOST_RATE), F.lit(1)).cast("int")
    one = poisson_inverse(uniform(seed, *key), rate)
    every = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + poisson_inverse(uniform(seed, *key, j), rate / parts))
    return F.when(parts == 1, one).otherwise(every)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, *, source_col: str = "source", text_col: str = "text", total: float | None = None, floor: float = 0.0) -> DataFrame:
    """(source key, size, rate) of each source; ``weights`` None: all sources alike, ``total`` None: the size that is there."""
    size = F.sum(F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)))
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    stats = docs.groupBy(key.alias("__source")).agg(size.cast("double").alias("__size"))
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        pairs = [F.lit(x) for k, v in sorted(weights.items(), key=lambda kv: kv[0] or "") for x in (k or "", float(v))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("__source")), F.lit(0.0)) if pairs else F.lit(0.0)
    stats = stats.withColumn("__weight", weight)
    sums = stats.agg(F.sum("__size").alias("__all"), F.sum("__weight").alias("__weights"))
    rate = F.col("__weight") / F.nullif("__weights", F.lit(0.0)) * (F.lit(float(total)) if total is not None else F.col("__all")) / F.col("__size")
    # one row of two sums, so the product has as many rows as there are sources
    return stats.join(F.broadcast(sums)).select("__source", "__size", F.greatest(F.coalesce(rate, F.lit(0.0)), F.lit(float(floor))).alias("__rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, *, seed: int = 7, total: float | None = None, floor: float = 0.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its source's rate says, shuffled; adds ``copy`` (from 1), ``rate`` and ``shuffle_key``.

    Columns of these three names in ``docs`` are replaced.
    """
    rates = source_rates(docs, weights, source_col=source_col, text_col=text_col, total=total, floor=floor)
    n_sources = docs.select(F.col(source_col)).distinct().limit(BROADCAST_SOURCES + 1).count()
    keyed = docs.withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    joined = keyed.join(F.broadcast(rates) if n_sources <= BROADCAST_SOURCES else rates, "__source")
    joined = joined.withColumn("__text", F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn("__row", F.monotonically_increasing_id())
    copies = joined.withColumn("__n", poisson_copies(seed, F.col("__rate"), F.col(id_col), F.col("__text")))
    out = [F.col(c) for c in docs.columns if c not in ("copy", "rate", "shuffle_key")]
    copy = F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy")
    rows = copies.where(F.col("__n") > 0).select(*out, F.col("__rate").alias("rate"), "__text", "__row", copy)
    rows = rows.withColumn("shuffle_key", uniform(seed + 1, F.col(id_col), F.col("__text"), F.col("copy"))).drop("__text")
    # equal rows have one key; their place in the scan deals them out
    return rows.repartition(F.col("shuffle_key"), F.col("__row")).sortWithinPartitions("shuffle_key").drop("__row")


def oracle_sql(seed: int = 7) -> str:
    """DuckDB SQL for ``mix_sources`` with equal weights over documents."""
    k = math.ceil(500 + _TAIL * math.sqrt(500) + 20)
    return f"""
WITH d AS (SELECT *, coalesce(source, '') AS k, greatest(coalesce(length(text), 0), 1) AS chars FROM documents),
s AS (SELECT k, sum(chars)::DOUBLE AS size FROM d GROUP BY k),
r AS (SELECT k, 1.0 / (SELECT count(*) FROM s)::DOUBLE * (SELECT sum(size) FROM s) / size AS rate FROM s),
u AS (SELECT d.*, r.rate, (('0x' || substr(md5(concat_ws(chr(31), '{seed}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM d JOIN r USING (k)),
terms AS (SELECT k, rate, i, exp(-rate + i * ln(rate) - lgamma(i + 1)) AS p FROM r, range(0, {k}) t(i) WHERE i <= rate + {_TAIL} * sqrt(rate) + 20),
cdf AS (SELECT k, i, sum(p) OVER (PARTITION BY k ORDER BY i) AS c FROM terms),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.rate, (SELECT count(*) FROM cdf WHERE cdf.k = u.k AND u.u > cdf.c) AS n FROM u),
e AS (SELECT doc_id, text, lang, source, n_chars, rate, unnest(range(1, n + 1))::INT AS copy FROM n WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, copy,
       (('0x' || substr(md5(concat_ws(chr(31), '{seed + 1}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), copy::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS shuffle_key
FROM e
"""
