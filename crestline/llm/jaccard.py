"""N-gram Jaccard join by grouped prefixes.

A text's set is the distinct hashes of its k-word shingles.  Equal sets are one class.
The shingles of all sets have one order; of two sets that link, the first
``n - ceil(t n) + 1`` shingles of each (the prefix) have one in common.  The order puts
a region of the hash space first and, inside it, shingles of few classes first: a class
whose prefix is full before it comes to a shingle of any other class links with nothing
and is done, and frequent passages come last.  Only the region is counted, which is
a fraction of all shingles; a set that is too small in the region goes on by hash.

What is left is grouped: classes with identical prefix and size are one group.  First
each class is verified with one other (the first of its group, or of the group that it
shares most of its prefix with), so that near copies are connected through stars, in as
many pairs as there are classes.  A shingle whose classes are all connected by then is
done.  Groups that share one of the other shingles meet, by components of the sharing,
in one unit; there group pairs are filtered by size and by position, then members are
expanded and verified on their whole sets.  A pair that is already connected is not
verified, and only edges of a spanning forest leave a unit, so a group of n near copies
makes n rows, not n squared.

A unit above ``UNIT_SHINGLES`` is narrowed first, in rounds that are linear in its
shingles.  All shingles of its classes are counted, and those that only connected classes
have come first in the order; a class whose prefix they fill is done.  A place in a prefix
stays if another class, not connected, has the same shingle and both could still link
by their sizes and what is left of them from there on.  The likeliest such partner is verified, so
the next round starts from larger components, and what stays meets in smaller units.
Only a unit that rounds do not narrow any more is split in blocks, and each pair of blocks
is a task: no pair is lost, and no task holds more than two blocks.  Many blocks are
verified in passes, each of which leaves its links alone on disk.

Defined cases: null and empty texts and texts of white space have an empty set and link
with nothing; a text of fewer than k words has its whole sequence as its one shingle;
repeated rows are members of one class; null ids are carried, and a component's id is
its smallest id that is not null; an empty table gives no rows; extra columns play no
part and are carried through by ``drop_near_duplicates``.  Rows are numbered in one
written table, which all later steps read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .kernel import U, shingle_sets
from .store import cut, drop, free_name, numbered

#: Shingles of all classes in one unit, or in one block of a split unit (320 kB): small, so that the tasks of a large unit are many and alike.
UNIT_SHINGLES = 40_000
#: A round goes on to the next if it leaves at most this share of the copies that blocks would take.
NARROWS = 0.9
#: Places of prefixes in one task, on average: all that share a shingle are in one.
PLACES = 4_000
#: Copies of the sets of all units that are on disk at once while units are verified.
COPIES_AT_ONCE = 2


def _prefix_length(n: int, num: int, den: int) -> int:
    return n + (-n * num // den) + 1


def _region(num: int, den: int) -> int:
    """Hashes below come first in the order: 1.6 times the share of a set that its prefix takes."""
    return int((1 << 63) * min(0.95, 1.6 * (den - num) / den))


def shingle_rows(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(row, id, n, digest, first shingles in hash order) of each row of (row, id, text)."""
    region = U(_region(num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, lists = [], [], []
            for s in shingle_sets(b.column(2), k):
                n = len(s)
                take = max(int(np.searchsorted(s, region)), _prefix_length(n, num, den)) if n else 0
                sizes.append(n)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                lists.append(s[:take].astype(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), tokens], ["row", "id", "n", "digest", "tokens"])

    return texts.select("row", "id", "text").mapInArrow(run, "row long, id long, n long, digest binary, tokens array<long>")


class Links:
    """Verified links among the classes of one unit, as components."""

    def __init__(self, sets: list[np.ndarray], prefixes: list[np.ndarray], skipped: list[int], num: int, den: int, known: np.ndarray | None = None):
        """``known``: labels of classes that are connected already."""
        self.sets, self.num, self.den = sets, num, den
        self.size = np.array([len(s) for s in sets], np.int64)
        self.component = np.arange(len(sets))
        if known is not None:
            _, first, label = np.unique(known, return_index=True, return_inverse=True)
            self.component = first[label]
        self._lists: tuple | None = None
        self._join(prefixes, np.array(skipped, np.int64))

    def _linked(self, common: np.ndarray, a: int, others: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (self.size[a] + self.size[others] - common)

    def _union(self, a: int, others: np.ndarray) -> None:
        olds = np.unique(self.component[np.append(others, a)])
        if len(olds) > 1:
            self.component[np.isin(self.component, olds)] = olds[0]

    def _common_with_all(self, a: int) -> np.ndarray:
        """Size of a's intersection with every set of the unit, through lists by shingle."""
        if self._lists is None:
            owner = np.repeat(np.arange(len(self.sets)), self.size)
            values = np.concatenate(self.sets)
            order = np.argsort(values, kind="stable")
            owner, values = owner[order], values[order]
            heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            self._lists = values[heads], np.append(heads, len(values)), owner
        names, heads, owner = self._lists
        at = np.searchsorted(names, self.sets[a])
        lo, hi = heads[at], heads[at + 1]
        more = hi - lo > 1
        lo, n = lo[more], (hi - lo)[more]
        if not len(n):
            return np.zeros(len(self.sets), np.int64)
        ends = np.cumsum(n)
        index = np.arange(ends[-1]) + np.repeat(lo - ends + n, n)
        return np.bincount(owner[index], minlength=len(self.sets))

    def _verify(self, a: int, others: np.ndarray) -> None:
        others = others[self.component[others] != self.component[a]]
        if len(others) > 8:
            common = self._common_with_all(a)[others]
            self._union(a, others[self._linked(common, a, others)])
            return
        for b in others.tolist():
            if self.component[a] != self.component[b]:
                x, y = (self.sets[a], self.sets[b]) if self.size[a] <= self.size[b] else (self.sets[b], self.sets[a])
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if self._linked(np.array([(y[at] == x).sum()]), a, np.array([b]))[0]:
                    self._union(a, np.array([b]))

    def _join(self, prefixes: list[np.ndarray], skipped: np.ndarray) -> None:
        by_key: dict[tuple[int, int, bytes], list[int]] = {}  # one place of the prefix for all of a group
        for i in np.argsort(self.size, kind="stable").tolist():
            by_key.setdefault((int(self.size[i]), int(skipped[i]), prefixes[i].tobytes()), []).append(i)
        groups = [np.array(m) for m in by_key.values()]
        heads = [m[0] for m in groups]
        n = self.size[heads]
        skip = skipped[heads]
        lengths = np.array([len(prefixes[h]) for h in heads])
        tokens = np.concatenate([prefixes[h] for h in heads])
        owner = np.repeat(np.arange(len(groups)), lengths)
        place = np.concatenate([np.arange(x) for x in lengths]) + skip[owner]
        order = np.argsort(tokens, kind="stable")  # owners of a token stay in order of size
        tokens_s, owner_s, place_s = tokens[order], owner[order], place[order]
        lows, highs = np.searchsorted(tokens_s, tokens), np.searchsorted(tokens_s, tokens, side="right")
        firsts = np.concatenate(([0], np.cumsum(lengths)))
        for g, members in enumerate(groups):
            found_o, found_y, found_x = [], [], []
            for t in range(firsts[g], firsts[g + 1]):
                lo = lows[t]
                hi = lo + int(np.searchsorted(owner_s[lo : highs[t]], g))  # smaller groups, and earlier ones of this size
                if hi > lo:
                    found_o.append(owner_s[lo:hi])
                    found_y.append(place_s[lo:hi])
                    found_x.append(np.full(hi - lo, place[t]))
            near = np.zeros(0, np.int64)
            if found_o:
                cand, first = np.unique(np.concatenate(found_o), return_index=True)
                py, px = np.concatenate(found_y)[first], np.concatenate(found_x)[first]
                m = n[cand]
                most = 1 + np.minimum(n[g] - 1 - px, m - 1 - py)
                least = -((-self.num * (n[g] + m)) // (self.num + self.den))
                near = cand[(self.den * m >= self.num * n[g]) & (most >= least)]
            others = np.concatenate([groups[y] for y in near.tolist()]) if len(near) else near
            for i, a in enumerate(members.tolist()):
                self._verify(a, np.concatenate((others, members[:i])))


def linked_classes(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n, keep_row, component_id) of each row: two sets link when den * common >= num * union.

    ``keep_row`` is the row of the component's smallest id, nulls last, ties by row.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return _linked(numbered(texts, "shingle-texts"), k, num, den)


def _linked(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """As ``linked_classes``, from a written table (row, id, text)."""
    with_tokens = cut(shingle_rows(texts, k, num, den), "shingle-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    of_set = with_tokens.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    token_classes = cut(of_set.withColumn("cid", F.monotonically_increasing_id()), "shingle-classes")
    rows, classes = cut(with_tokens.drop("tokens"), "shingle-row-sizes"), cut(token_classes.drop("tokens"), "class-sizes")
    drop(with_tokens)
    edges = _verified_edges(texts, token_classes, k, num, den)
    roots = edges.select(F.col("b").alias("cid"), F.col("b").alias("root")).distinct().unionByName(edges.select(F.col("a").alias("cid"), F.col("b").alias("root")))
    labelled = classes.select("digest", "cid", "first").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    heads = labelled.groupBy("root").agg(F.min("first").alias("head"))
    of_class = cut(labelled.join(heads, "root").select("digest", "head"), "class-heads")
    found = rows.select("row", "id", "n", "digest").join(of_class, "digest", "left")
    alone = F.col("n") == 0
    return found.select(
        "row", "id", "n",
        F.when(alone, F.col("row")).otherwise(F.col("head.row")).alias("keep_row"),
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("component_id"),
    )


def _verified_edges(texts: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) from each linked class to its component's root."""
    region = _region(num, den)
    exploded = classes.select("cid", F.explode("tokens").alias("token"))
    shared = cut(exploded.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), "shared-shingles")
    later = F.col("token") >= region
    ranked = F.struct(later.alias("later"), F.when(later, 0).otherwise(F.col("df")).alias("df"), "token")
    common = exploded.join(shared, "token").groupBy("cid").agg(F.sort_array(F.collect_list(ranked)).alias("common"))
    length = F.expr(f"n + 1 - (n * {num} + {den - 1}) div {den}")
    alone = F.size("tokens") - F.size("common")
    prefix = F.transform(F.slice("common", F.lit(1), F.greatest(F.col("left"), F.lit(0))), lambda s: s["token"])
    survivors = (
        classes.join(common, "cid")
        .withColumn("left", (length - alone).cast("int"))
        .where("left > 0")
        .withColumn("skipped", F.when(F.element_at("tokens", -1) >= region, F.lit(0)).otherwise(alone))
        .withColumn("prefix", prefix)
        .select("cid", "n", F.col("first.row").alias("row"), "skipped", "prefix", F.xxhash64("n", "prefix").alias("grp"))
    )
    survivors = cut(survivors, "prefix-classes")
    drop(classes, shared)

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(b.column("text"), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("cid"), sets], ["cid", "set"])

    # texts are the large side of this join: they pass by a hash table of rows and are not sorted
    with_text = texts.select("row", "text").join(survivors.select("cid", "row").hint("shuffle_hash"), "row").select("cid", "text")
    sets = cut(with_text.mapInArrow(whole_sets, "cid long, set binary"), "whole-sets")
    lists = survivors.select("grp", F.explode("prefix").alias("token")).distinct()
    least = cut(lists.groupBy("token").agg(F.min("grp").alias("least")), "prefix-least")
    sharing = cut(lists.join(least, "token").select(F.col("grp").alias("a"), F.col("least").alias("b"), "token"), "prefix-sharing-lists")
    near = cut(_linked_pairs(_star_pairs(survivors, sharing), sets, num, den), "star-links")
    roots = components(near, "stars").select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    labelled = cut(survivors.join(roots, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "starred-classes")
    # a shingle whose classes are all connected by now has nothing left to join
    of_token = labelled.select("comp", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_tokens = cut(of_token.where("lo < hi").select("token"), "open-shingles")
    open_sharing = cut(sharing.join(open_tokens, "token", "left_semi").select("a", "b").distinct(), "open-sharing")
    meet = components(open_sharing, "prefix-sharing").select(F.col("node").alias("grp"), F.col("root").alias("unit"))
    # a group that shares open shingles with no other is a unit of its own: its members need not all link with its first
    unit_of = open_sharing.select(F.col("a").alias("grp")).distinct().join(meet, "grp", "left").withColumn("unit", F.coalesce("unit", "grp"))
    units = cut(labelled.join(unit_of, "grp").drop("grp", "row"), "prefix-units")
    work, copies = _sized(units)
    small, made = [], [units, work]
    while copies:
        small.append(work.where("blocks = 1"))
        links, units = _narrowed(work.where("blocks > 1"), sets, num, den)
        near = near.unionByName(links)
        before = copies
        work, copies = _sized(units)
        made += [units, work]
        if copies > NARROWS * before:
            break
    for part in small:
        work = work.unionByName(part)
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    placed = work.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cid", "comp", "unit", "skipped", "prefix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # a class goes to as many tasks as its unit has blocks: in passes, so that the copies on disk at once do not grow with the blocks
    once, copies = work.agg(F.sum("n"), F.sum(F.col("n") * F.col("blocks"))).first()
    passes = -(-(copies or 0) // (COPIES_AT_ONCE * (once or 1))) or 1
    at = F.pmod(F.xxhash64("unit", "i", "j"), F.lit(passes))

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        cid = table.column("cid").to_numpy()
        whole = [np.frombuffer(x, U) for x in table.column("set").to_pylist()]
        prefixes = [np.array(x, np.int64) for x in table.column("prefix").to_pylist()]
        start = table.column("comp").to_numpy()
        found = Links(whole, prefixes, table.column("skipped").to_pylist(), num, den, start).component
        least = np.full(len(cid), np.iinfo(np.int64).max)
        np.minimum.at(least, found, cid)
        root = least[found]
        real = root != cid
        return pa.table({"a": pa.array(cid[real]), "b": pa.array(root[real])})

    edges = near
    for p in range(passes):
        part = (placed.where(at == p) if passes > 1 else placed).join(sets, "cid")
        edges = edges.unionByName(cut(part.groupBy("unit", "i", "j").applyInArrow(verify, "a long, b long"), "verified-links"))
    drop(sets, survivors, labelled, sharing, least, open_tokens, open_sharing, *made)
    return components(edges, "links").where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _sized(units: DataFrame) -> tuple[DataFrame, int]:
    """``units`` with the number of blocks of each unit, and the shingles of all copies that the blocks of split units take."""
    blocks = F.ceil(F.sum("n") / UNIT_SHINGLES).cast("int")
    work = cut(units.join(units.groupBy("unit").agg(blocks.alias("blocks")), "unit"), "unit-classes")
    return work, work.where("blocks > 1").agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0


def _partners(unit: np.ndarray, token: np.ndarray, comp: np.ndarray, n: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places that stay, the likeliest partner of each): two places of one shingle are partners if each class is at most as large as the other reaches, and of another component."""
    rows = np.lexsort((n, token, unit))
    while True:
        u, t, c, size, r = unit[rows], token[rows], comp[rows], n[rows], reach[rows]
        at = np.arange(len(rows))
        new = np.ones(len(rows), bool)
        new[1:] = (u[1:] != u[:-1]) | (t[1:] != t[:-1])
        shingle = np.cumsum(new) - 1
        wide = int(max(size.max(initial=0), r.max(initial=0))) + 1
        # of the classes up to this size: which reaches most, and which most of those not in that one's component
        first = _running_argmax(shingle, r, at)
        lead = c[first]
        turn = new.copy()
        turn[1:] |= lead[1:] != lead[:-1]
        other = np.where(c != lead, at, -1)
        led = turn & ~new
        other[led] = first[np.flatnonzero(led) - 1]
        second = _running_argmax(np.cumsum(turn) - 1, np.where(other >= 0, r[other], -1), other)
        last = np.searchsorted(shingle * wide + size, shingle * wide + r, side="right") - 1
        some = last >= np.flatnonzero(new)[shingle]
        best = np.where(c[first[last]] != c, first[last], second[last])
        stays = some & (best >= 0) & (r[best] >= size)
        if stays.all():
            return rows, rows[best]
        rows = rows[stays]


def _running_argmax(part: np.ndarray, value: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Name of the largest value up to here within each part (parts ascend; values are -1 at least)."""
    key = part * (int(value.max(initial=0)) + 2) + value + 1
    most = np.maximum.accumulate(key)
    rises = np.ones(len(key), bool)
    rises[1:] = most[1:] > most[:-1]
    return name[np.maximum.accumulate(np.where(rises, np.arange(len(key)), 0))]


def _narrowed(large: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links, units): links (a, b) found on the way, and the classes of ``large`` that can still link with one of another component, in new units."""

    def as_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("set")]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cid", "unit", "comp", "n")), tokens], ["cid", "unit", "comp", "n", "tokens"])

    whole = large.select("cid", "unit", "comp", "n").join(sets, "cid").mapInArrow(as_lists, "cid long, unit long, comp long, n long, tokens array<long>")
    whole = cut(whole, "narrow-sets")
    exploded = whole.select("cid", "unit", "comp", "n", F.explode("tokens").alias("token"))
    counted = exploded.groupBy("unit", "token").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_tokens = cut(counted.where("lo < hi").select("unit", "token", "df"), "narrow-open-shingles")
    ranked = exploded.join(open_tokens, ["unit", "token"]).groupBy("cid", "unit", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    left = F.expr(f"n + 1 - (n * {num} + {den - 1}) div {den} - skipped").cast("int")
    prefix = F.transform(F.slice("common", F.lit(1), F.col("left")), lambda s: s["token"])
    lists = ranked.withColumn("skipped", (F.col("n") - F.size("common")).cast("int")).withColumn("left", left).where("left > 0")
    lists = cut(lists.select("cid", "unit", "comp", "n", "skipped", prefix.alias("prefix")), "narrow-prefixes")
    drop(whole, open_tokens)
    # the largest set that can link with this one if they have nothing in common before this place
    reach = F.expr(f"((n - skipped - place) * {num + den} - n * {num}) div {num}")
    places = lists.select("unit", "comp", "cid", "n", "skipped", F.posexplode("prefix").alias("place", "token"))
    places = places.select("unit", "token", "comp", "cid", "n", reach.alias("reach")).where("reach > 0")
    parts = (lists.agg(F.sum(F.size("prefix"))).first()[0] or 0) // PLACES + 1

    def partners(table: pa.Table) -> pa.Table:
        stays, other = _partners(*(table.column(c).to_numpy() for c in ("unit", "token", "comp", "n", "reach")))
        kept = table.select(["unit", "token", "cid"]).take(pa.array(stays))
        return kept.append_column("other", table.column("cid").take(pa.array(other)))

    dealt = places.groupBy(F.pmod(F.xxhash64("unit", "token"), F.lit(parts)).alias("part"))
    stay = cut(dealt.applyInArrow(partners, "unit long, token long, cid long, other long"), "narrow-places")
    pairs = cut(stay.select(F.greatest("cid", "other").alias("a"), F.least("cid", "other").alias("b")).distinct(), "partner-pairs")
    links = cut(_linked_pairs(pairs, sets, num, den), "verified-links")
    known = lists.where("cid <> comp").select(F.col("cid").alias("a"), F.col("comp").alias("b"))
    roots = components(links.unionByName(known), "partners").select(F.col("node").alias("cid"), "root")
    lists_now = lists.drop("unit").join(roots, "cid", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    of_place = cut(stay.drop("other").join(lists_now.select("cid", "comp"), "cid"), "narrow-comps")
    met = of_place.groupBy("unit", "token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cid").alias("least")).where("lo < hi")
    sharing = cut(of_place.join(met.select("unit", "token", "least"), ["unit", "token"]).select(F.col("cid").alias("a"), F.col("least").alias("b")).distinct(), "narrow-sharing")
    meet = components(sharing, "narrow-units").select(F.col("node").alias("cid"), F.col("root").alias("unit"))
    units = cut(lists_now.join(meet, "cid"), "narrow-classes")
    drop(lists, stay, pairs, of_place, sharing)
    return links, units


def _star_pairs(survivors: DataFrame, sharing: DataFrame) -> DataFrame:
    """(a, b): each class with the first of its group, and the first of each group with that of the group it shares most shingles with, of those that come first for a shingle."""
    firsts = survivors.groupBy("grp").agg(F.min("cid").alias("first"))
    inside = survivors.select("grp", F.col("cid").alias("a")).join(firsts, "grp").where("a <> first").select("a", F.col("first").alias("b"))
    shared = sharing.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pivots = shared.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")).select(F.col("a").alias("grp"), F.col("b").alias("pivot"))
    across = pivots.join(firsts, "grp").join(firsts.select(F.col("grp").alias("pivot"), F.col("first").alias("b")), "pivot")
    return cut(inside.unionByName(across.select(F.col("first").alias("a"), "b")), "star-pairs")


def _linked_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row."""
    found = linked_classes(docs, k=k, num=num, den=den, id_col=id_col, text_col=text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``docs``: the one with the smallest id."""
    row = free_name(docs, "__row")
    rows = numbered(docs, "shingle-rows-whole", row)
    texts = rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = _linked(texts, k, num, den).where("row = keep_row").select(F.col("row").alias(row))
    return rows.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
