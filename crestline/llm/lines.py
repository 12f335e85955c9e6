"""Line deduplication with a log-template tree, in DataFrame functions only.

A line is parsed by a tree of fixed depth: its number of words, then its first
``LEADING`` words; words with a digit are variable fields from the start.  In a leaf that
lines of ``min_docs`` different texts reach, a word that fewer than ``min_docs`` lines
have at its place is a variable field too, which gives the line its template.  Lines
whose template recurs in ``min_docs`` different texts are dropped, wherever they are,
if at most ``max_variable`` of the template's words are variable and the line has
``min_words`` words (one: lines of every length); all other lines stay, so prose that
only begins alike does.

Leaves, places and templates are counted over distinct lines with their multiplicity,
so a line that a third of all documents share is one row after the first aggregation.
Equal texts count as one document, so copies of a text do not make its lines recur.

Defined cases: a null text counts as empty and has one line without words; lines without
words always stay; a text whose lines all go becomes empty; repeated rows are cleaned
each; an empty table gives no rows; extra columns are carried through by ``clean_lines``
(``n_lines`` and ``n_dropped`` replace columns of these names).  Rows are numbered in one
written table, which all later steps read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import cut, free_name, numbered

LEADING = 3
VARIABLE = "<*>"
_WHITE = r"\t\x0B\x0C\r"


def _masked(line: Column) -> Column:
    """Words of a line with one space between them, those with a digit masked; only odd lines are rewritten.

    Both patterns look at each character a bounded number of times, however long a word is.
    """
    plain = F.when(line.rlike(f"[{_WHITE}]|  |^ | $"), F.trim(F.regexp_replace(line, f"[ {_WHITE}]+", " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)).otherwise(plain)


def _exploded(texts: DataFrame, min_words: int) -> DataFrame:
    """(row, doc, pos, masked, size) of each line with so many words, and one at least."""
    # masked inside the generator: a filter cannot be pushed below it and mask again
    masked = texts.select("row", F.xxhash64("text").alias("doc"), F.posexplode(F.transform(F.split("text", "\n", -1), _masked)).alias("pos", "masked"))
    size = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1
    return masked.where("masked <> ''").withColumn("size", size).where(F.col("size") >= min_words)


def _leaf(masked: Column, size: Column) -> Column:
    return F.xxhash64(size, F.substring_index(masked, " ", LEADING))


def recurring_lines(docs: DataFrame, *, min_docs: int = 10, max_variable: float = 0.3, min_words: int = 1, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((row, pos) of the lines to drop, (line, template, docs) of the templates that recur)."""
    return _recurring(_texts(docs.select(text_col), text_col), min_docs, max_variable, min_words)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return numbered(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "line-texts")


def _recurring(texts: DataFrame, min_docs: int, max_variable: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """As ``recurring_lines``, from a written table (row, text)."""
    lines = _exploded(texts, min_words).withColumn("leaf", _leaf(F.col("masked"), F.col("size")))
    places = cut(lines.select("row", "doc", "pos", "leaf", F.xxhash64("masked").alias("line")), "line-places")
    wide = places.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    wide = cut(wide.select("leaf"), "line-leaves")
    distinct = lines.select("leaf", "masked").join(wide, "leaf")
    distinct = distinct.groupBy("leaf", "masked").agg(F.count(F.lit(1)).alias("n"))
    distinct = cut(distinct.select("leaf", F.xxhash64("masked").alias("line"), F.split("masked", " ").alias("words"), "n"), "distinct-lines")
    words = distinct.select("leaf", "line", "n", F.posexplode("words").alias("at", "word"))
    support = words.groupBy("leaf", "at", "word").agg(F.sum("n").alias("support"))
    known = cut(support.where((F.col("support") >= min_docs) & (F.col("word") != VARIABLE)).select("leaf", "at", "word"), "line-constants")
    marked = words.join(known.withColumn("fixed", F.lit(True)), ["leaf", "at", "word"], "left")
    parts = F.sort_array(F.collect_list(F.struct("at", F.when(F.col("fixed"), F.col("word")).otherwise(F.lit(VARIABLE)).alias("w"))))
    templates = marked.groupBy("leaf", "line").agg(parts.alias("parts")).select("leaf", "line", F.transform("parts", lambda p: p["w"]).alias("template"))
    variable = F.size(F.filter("template", lambda w: w == VARIABLE))
    usable = templates.where(variable <= max_variable * F.size("template")).select("line", F.array_join("template", " ").alias("template"))
    usable = cut(usable, "line-templates")
    seen = places.join(usable, "line").select("template", "doc").distinct()
    # written, so that the join is one that adaptive execution can split at a template of many lines
    recurring = cut(seen.groupBy("template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs), "recurring-templates")
    dropped = cut(usable.join(recurring, "template"), "dropped-lines")
    return places.join(dropped.select("line"), "line", "left_semi").select("row", "pos"), dropped


def clean_lines(docs: DataFrame, *, min_docs: int = 10, max_variable: float = 0.3, min_words: int = 1, text_col: str = "text") -> DataFrame:
    """``docs`` without the recurring lines, with ``n_lines`` and ``n_dropped``."""
    kept = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    row, gone_at, text = (free_name(docs, c) for c in ("__row", "__drop", "__text"))
    rows = numbered(docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text)), "line-rows", row)
    drop, _ = _recurring(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), min_docs, max_variable, min_words)
    per_row = cut(drop.groupBy(F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone_at)), "dropped-places")
    # the rows with lines to drop grow with the corpus, so they are never broadcast; texts pass by them and are not sorted
    whole = rows.join(per_row.hint("shuffle_hash"), row, "left")
    lines = F.split(text, "\n", -1)
    gone = F.map_from_arrays(F.col(gone_at), F.transform(gone_at, lambda p: F.lit(True)))
    left = F.transform(F.array(gone), lambda m: F.filter(lines, lambda line, i: ~F.coalesce(F.try_element_at(m, i), F.lit(False))))[0]
    cleaned = F.when(F.col(gone_at).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    n_dropped = F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at))
    return whole.select(*kept, cleaned.alias(text_col), F.size(lines).alias("n_lines"), n_dropped.alias("n_dropped"))


def oracle_sql(min_docs: int = 10, max_variable: float = 0.3, min_words: int = 1) -> str:
    """DuckDB SQL for ``clean_lines`` over documents."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT doc_id, sha256(t) AS doc, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
w AS (SELECT doc_id, doc, pos, list_transform(list_filter(string_split(translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> ''),
             lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{VARIABLE}' ELSE x END) AS words FROM l),
k AS (SELECT *, (len(words) || '|' || array_to_string(words[1:{LEADING}], ' ')) AS leaf, array_to_string(words, ' ') AS key FROM w WHERE len(words) >= {min_words}),
wide AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT doc) >= {min_docs}),
dl AS (SELECT leaf, key, any_value(words) AS words, count(*) AS n FROM k WHERE leaf IN (SELECT leaf FROM wide) GROUP BY leaf, key),
pw AS (SELECT leaf, key, n, unnest(words) AS word, unnest(range(len(words))) AS place FROM dl),
known AS (SELECT leaf, place, word FROM pw WHERE word <> '{VARIABLE}' GROUP BY leaf, place, word HAVING sum(n) >= {min_docs}),
m AS (SELECT pw.leaf, pw.key, pw.place, CASE WHEN known.word IS NULL THEN '{VARIABLE}' ELSE pw.word END AS x FROM pw LEFT JOIN known USING (leaf, place, word)),
tp AS (SELECT leaf, key, string_agg(x, ' ' ORDER BY place) AS template, sum((x = '{VARIABLE}')::INT) AS var, count(*) AS size FROM m GROUP BY leaf, key),
usable AS (SELECT key, template FROM tp WHERE var <= {max_variable} * size),
rec AS (SELECT template FROM k JOIN usable USING (key) GROUP BY template HAVING count(DISTINCT doc) >= {min_docs}),
gone AS (SELECT DISTINCT doc_id, pos FROM k JOIN usable USING (key) WHERE template IN (SELECT template FROM rec)),
g AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ls)::INT AS n_lines, coalesce(len(ps), 0)::INT AS n_dropped,
       sha256(CASE WHEN ps IS NULL THEN t ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(ps, i - 1)), chr(10)) END) AS text_sha256
FROM split LEFT JOIN g USING (doc_id)
"""
