"""Exact deduplication by deterministic block naming, in DataFrame functions only.

Each text is cut into blocks of a fixed number of characters.  All distinct blocks are
sorted and numbered; the number is the block's name.  Then adjacent names are paired,
distinct pairs are sorted and numbered in turn, and so on until each document has one
name.  Two documents have the same name at the same level if and only if their texts
are the same: names are compared by the blocks themselves, never by a hash alone.

Blocks travel once, for sorting; a document's blocks find their names by a 64-bit hash,
and blocks whose hash is shared by another block are matched by the block itself.  Each
distinct block leaves a task once at most, so a text with many copies is no hot key
there; the joins that bring names back carry a few integers a block, and adaptive
execution splits a hot hash.  The number of levels is the logarithm of the longest
text's number of blocks; the documents that take part halve in blocks at each level.

Defined cases: null counts as empty, and all empty texts are equal; of equal texts the
row with the largest id stays (a null id is the smallest; of rows with the same id, one
row); an empty table gives no rows; extra columns play no part in equality and are
carried through by ``drop_exact_duplicates``.  Rows are numbered in one written table,
which all later steps read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .store import cut, free_name, numbered

BLOCK_CHARS = 4096


def _blocks(text: Column, block_chars: int) -> Column:
    """Blocks of a text in order; one empty block for an empty text."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))


def _block_names(texts: DataFrame, block_chars: int) -> DataFrame:
    """(h, shared, name, block) of all distinct blocks, numbered in the order of hash and block.

    ``shared``: another block has the same hash; only then ``block`` is kept.  A task sends
    each of its distinct blocks once, and ``variants`` holds the few blocks of one 64-bit hash.
    """
    blocks = texts.select(F.explode(_blocks(F.col("__text"), block_chars)).alias("block"))
    by_hash = blocks.groupBy(F.xxhash64("block").alias("h")).agg(F.sort_array(F.collect_set("block")).alias("variants"))
    each = by_hash.sortWithinPartitions("h").select("h", (F.size("variants") > 1).alias("shared"), F.explode("variants").alias("block"))
    return each.withColumn("name", F.monotonically_increasing_id()).select("h", "shared", "name", F.when(F.col("shared"), F.col("block")).alias("block"))


def name_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, id, text_sha256, level, name) of each row; (level, name) identifies the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return _name_rows(numbered(docs.select(F.col(id_col).alias("__id"), text.alias("__text")), "dedup-texts", "__row"), block_chars)


def _name_rows(texts: DataFrame, block_chars: int) -> DataFrame:
    """As ``name_texts``, from a written table (__row, __id, __text)."""
    names = cut(_block_names(texts, block_chars), "block-names")
    hashes = F.transform(_blocks(F.col("__text"), block_chars), lambda b: F.xxhash64(b))
    rows = texts.select(F.col("__row").alias("row"), "__id", F.sha2(F.col("__text"), 256).alias("text_sha256"), hashes.alias("hashes"))
    skeleton = cut(rows, "dedup-rows")
    longest = skeleton.agg(F.max(F.size("hashes"))).first()[0] or 1
    levels = math.ceil(math.log2(longest)) if longest > 1 else 0

    places = skeleton.select("row", F.posexplode("hashes").alias("pos", "h"))
    named = places.join(names.where(~F.col("shared")).select("h", "name"), "h", "left")
    if not names.where("shared").isEmpty():
        # exact way for blocks with a common hash: by the block itself
        same = names.where("shared").select("h", "block", F.col("name").alias("__by_block"))
        again = texts.select(F.col("__row").alias("row"), F.posexplode(_blocks(F.col("__text"), block_chars)).alias("pos", "block"))
        by_block = again.withColumn("h", F.xxhash64("block")).join(same, ["h", "block"]).select("row", "pos", "__by_block")
        named = named.join(by_block, ["row", "pos"], "left").withColumn("name", F.coalesce("name", "__by_block")).drop("__by_block")
    current = cut(_lists(named), "names-0")
    done = []
    for level in range(levels):
        done.append(current.where(F.size("names") == 1).select("row", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        longer = current.where(F.size("names") > 1)
        pairs = longer.select("row", F.posexplode(_pairs(F.col("names"))).alias("pos", "p")).select("row", "pos", "p.a", "p.b")
        distinct = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("__n")).sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name"))
        current = cut(_lists(pairs.join(cut(distinct, f"pair-names-{level + 1}"), ["a", "b"])), f"names-{level + 1}")
    done.append(current.select("row", F.lit(levels).alias("level"), F.col("names")[0].alias("name")))
    identity = done[0]
    for d in done[1:]:
        identity = identity.unionByName(d)
    return skeleton.select("row", "__id", "text_sha256").join(identity, "row")


def _lists(named: DataFrame) -> DataFrame:
    """Names of each row in order; a list is no longer than its text's blocks."""
    got = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return got.select("row", F.col("x.name").alias("names"))


def _pairs(names: Column) -> Column:
    """Adjacent names in pairs; a last odd one is paired with -1."""
    at = F.sequence(F.lit(0), F.floor((F.size(names) - 1) / 2).cast("int"))
    return F.transform(at, lambda i: F.struct(F.element_at(names, (i * 2 + 1).cast("int")).alias("a"), F.coalesce(F.try_element_at(names, (i * 2 + 2).cast("int")), F.lit(-1)).alias("b")))


def _groups(named: DataFrame, id_col: str) -> DataFrame:
    # rows of one level and name carry one text; the pair is the group's key
    # (written, so that the join is one that adaptive execution can split at a large group)
    groups = cut(named.groupBy("level", "name").agg(F.max(F.struct("__id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        "row", F.col("__id").alias(id_col), F.col("keep.__id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256",
    )


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, id, keep_id, group_size, kept, text_sha256) of each row of ``docs``."""
    return _groups(cut(name_texts(docs, id_col=id_col, text_col=text_col, block_chars=block_chars), "identities"), id_col)


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = free_name(docs, "__row")
    rows = numbered(docs, "dedup-rows-whole", row)
    texts = rows.select(F.col(row).alias("__row"), F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    named = cut(_name_rows(texts, BLOCK_CHARS), "identities")
    kept = _groups(named, id_col).where("kept").select(F.col("row").alias(row))
    return rows.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
