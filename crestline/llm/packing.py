"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity``.  Only the histogram of piece
lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver.  There a
plan is made of patterns, each a list of lengths and how many sequences repeat it:
for each length, from long to short, the gap that it leaves is looked up among the
sums of one, two and three lengths that are still available, and a combination that
fills the gap exactly is consumed as often as the counts allow; what finds none is
placed by best fit.  Pieces then take their place by their rank among the pieces of
their length, so nothing but the plan is broadcast (a few thousand rows, bounded by
``capacity``).

Defined cases: a null or empty text is one document of the end token alone; longer
documents than ``capacity`` are cut and only they; repeated rows are packed each;
null ids are carried; an empty table gives no rows.  Extra columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from .store import cut

_TRAIL = "".join(map(chr, [*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
#: Words whose ids a worker keeps (about 110 MB at most); beyond, it starts anew.
CACHE_WORDS = 500_000
_cache: dict[str, dict] = {}


class WordTokenizer:
    """Ids, as little-endian unsigned 32-bit bytes, of a tokenizer that drops white space.

    Such a tokenizer treats the words between white space independently, so each word is
    encoded once for a worker.  Letters are looked up in lower case, and apart from the
    ASCII punctuation behind them, which it splits off (an apostrophe stays: it can start
    a token of its own).  ``tests/llm`` holds this against whole texts.
    """

    def __init__(self, path: str):
        known = _cache.get(path)
        if known is None:
            t = Tokenizer.from_file(path)
            last = np.zeros(max(t.get_vocab().values()) + 1, bool)
            last[[i for token, i in t.get_vocab().items() if token.endswith("</w>")]] = True
            known = _cache[path] = {"t": t, "words": {}, "last": last}
        self.tokenizer, self.known, self.last = known["t"], known["words"], known["last"]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: encoded as one text, and cut where a token ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(words):
            return self._ids(words)
        flat, at = ids.tobytes(), ends.tolist()
        return [flat[a:b] for a, b in zip([0, *at], at, strict=False)]

    def _learn(self, words: set[str]) -> None:
        plan: dict[str, tuple[str, ...]] = {}
        letters, mixed = set(), set()
        for w in words:
            core = w.rstrip(_TRAIL)
            if core.isalpha() and (core.isascii() or core.lower().isalpha()):
                if core.isascii() or max(core) < "\u0100":  # where lower case is one letter for one
                    core = core.lower()
                tail = w[len(core) :]
                plan[w] = (core, tail)
                letters.add(core)
                mixed.add(tail)
            else:
                plan[w] = (w,)
                mixed.add(w)
        for new, ids in ((letters, self._letters), (mixed, self._ids)):
            fresh = [c for c in new if c and c not in self.known]
            if fresh:
                self.known.update(zip(fresh, ids(fresh), strict=True))
        for w, parts in plan.items():
            if w not in self.known:
                self.known[w] = b"".join(self.known[c] for c in parts if c)

    def encode(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split alone
            return self._ids([text])[0]
        words = text.split()
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            self._learn({w for w in words if w not in self.known})
            found = [self.known[w] for w in words]
        return b"".join(found)


def tokenise(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece, with its partition and its rank among the partition's pieces of its length."""
    as_long = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows: list[tuple] = []
                block = b.slice(lo, 256)
                for doc, text in zip(block.column(0).to_pylist(), block.column(1), strict=True):
                    ids = tok.encode(text.as_py() or "") + end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        x = ids[4 * start : 4 * (start + capacity)]
                        n = len(x) // 4
                        rows.append((doc, piece, start, n, zlib.crc32(x), part, seen[n], x if with_ids else None))
                        seen[n] += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", "ids"]
                keep = 8 if with_ids else 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:keep], kinds[:keep], strict=True)], names[:keep])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
    return as_long.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


class _Sums:
    """Combinations of up to three available lengths with an exact sum."""

    def __init__(self, counts: np.ndarray):
        self.n = counts

    def pair(self, gap: int, top: int) -> tuple[int, int] | None:
        """(a, b), a >= b, a + b = gap, with the largest a."""
        a = np.arange(min(top, gap - 1), (gap + 1) // 2 - 1, -1)
        if not len(a):
            return None
        ok = (self.n[a] > 0) & (self.n[gap - a] > 0) & ((2 * a != gap) | (self.n[a] > 1))
        at = int(np.argmax(ok))
        return (int(a[at]), int(gap - a[at])) if ok[at] else None

    def find(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        if gap <= 0:
            return None
        if self.n[gap] > 0:
            return (gap,)
        if most < 2:
            return None
        if p := self.pair(gap, gap - 1):
            return p
        if most < 3:
            return None
        there = np.flatnonzero(self.n[: gap - 1])
        for a in there[::-1].tolist():
            if a * 3 < gap:
                break
            self.n[a] -= 1
            p = self.pair(gap - a, a)
            self.n[a] += 1
            if p:
                return (a, *p)
        return None


Patterns = list[tuple[tuple[int, ...], int]]


def plan_patterns(histogram: dict[int, int], capacity: int) -> Patterns:
    """(lengths, number of sequences) that use up the histogram, in as few sequences as found.

    The index is tried with sums of three, two and one lengths: where lengths are few, longer
    sums can use up short pieces that others need.  It stops at the least that is possible.
    """
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    best: Patterns | None = None
    for most in (3, 2, 1):
        found = _plan(histogram, capacity, most)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) == least:
            break
    return best or []


def _plan(histogram: dict[int, int], capacity: int, most: int) -> Patterns:
    n = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        n[length] = count
    out: Patterns = []
    sums = _Sums(n)
    for length in range(capacity, 0, -1):
        while n[length]:
            if length == capacity:
                out.append(((length,), int(n[length])))
                n[length] = 0
                break
            n[length] -= 1
            rest = sums.find(capacity - length, most)
            n[length] += 1
            if rest is None:
                break
            pattern = (length, *rest)
            times = min(int(n[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                n[x] -= times
            out.append((pattern, times))
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_gap = np.zeros(capacity + 1, bool)

    def add(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            gaps.setdefault(gap, []).append((pattern, times))
            open_gap[gap] = True

    for length in range(capacity, 0, -1):
        left = int(n[length])
        while left:
            fits = np.flatnonzero(open_gap[length:])
            if len(fits):
                gap = int(fits[0]) + length
                pattern, times = gaps[gap].pop()
                if not gaps[gap]:
                    open_gap[gap] = False
                used = min(times, left)
                add(gap, pattern, times - used)
                add(gap - length, (*pattern, length), used)
                left -= used
            else:
                each = capacity // length
                add(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    add(capacity - (left % each) * length, (length,) * (left % each), 1)
                left = 0
    return out + [x for found in gaps.values() for x in found]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of rank 0, offset): where the pieces of each length go."""
    used: dict[int, int] = {}
    out, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            at = used.get(length, 0)
            out.append((length, at, at + times, base - at, offset))
            used[length] = at + times
            offset += length
        base += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = cut(tokenise(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = slots(plan_patterns(histogram, capacity))
    places = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, base long, offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local"))
    p = F.broadcast(places.withColumnRenamed("length", "of"))
    placed = ranked.join(p, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    ids = [F.col("ids")] if with_ids else []
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, (F.col("base") + F.col("rank")).alias("sequence_id"), "offset")
