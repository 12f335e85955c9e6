"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and one end for each text.  All training tokens are
counted.  Every word has a place in a tree of classes within classes, ``BRANCH`` wide:
the most frequent words have leaves of their own near the root (``SHORT``), all other
words share the leaves of the deep classes by their hash, where the depth grows with
the vocabulary.  The probability of a token is the product of a softmax at each class
on its path, given the context, times the word's share of its leaf's add-one counts
(one for a leaf of its own).  All words together, one unseen word included, have
probability one.  Biases are logarithms of the add-one counts below each branch, so the
untrained model is the add-one model, and training can only move it by what contexts say.

Features of the root are the word before, the two words before (a trigram), and the word
before the last alone (a skip); of the classes below, the word before with the class.
Each is hashed to a row of weights.  Training is by rounds over disjoint parts of all
training texts: each task makes gradient steps from the model it was sent, with a rate
for each row of weights that falls with the row's use, and rows of weights are averaged
over tasks by how often each task used them; tasks send the rows that they used.  Rows
of weights double with the tokens up to ``2**MAX_BITS`` for each table, which bounds the
model that is broadcast; beyond that, contexts collide.

Counts of the ``TOP_WORDS`` most frequent words at most are broadcast; tokens beyond
them find their exact count by a join.  Words are told apart by 64-bit hashes
(``kernel``), so equal hashes would be counted as one word.

Defined cases: a null or empty text is one end token; texts of any length are scored
whole; repeated rows are scored (and counted) each; a null id is in the training part;
without training rows every count is 0 and the one unseen word has probability one;
an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .kernel import U, mix, rows_of_words
from .store import collected, cut

BRANCH, _SHIFT = 16, 4
#: (first class, classes, depth) of the classes whose leaves are single frequent words; the rest are deep.
SHORT = ((0, 6, 2), (6, 5, 3), (11, 3, 4))
DEEP_FIRST, DEEP_CLASSES = 14, 2
#: Depth of the deep classes: 2**17 leaves, or 2**21 above so many distinct words.
DEPTHS, DEEPER_ABOVE = (5, 6), 1_000_000
PLACED = sum(n * BRANCH ** (depth - 1) for _, n, depth in SHORT)
TOP_WORDS = 1 << 18
MIN_BITS, MAX_BITS = 12, 17
ROUNDS, BATCH, RATE = 3, 4096, 0.35
#: Training tokens of one task in one round.
TASK_TOKENS = 4_000_000
#: Rows of weights that travel together, and how many tasks' weights one task adds up.
BLOCK_ROWS, FAN_IN = 2048, 64
_END, _START, _UNSEEN = 0x1D8E4E27C47D124F, 0x6A09E667F3BCC909, 0x3C6EF372FE94F82B
_SALTS = (U(0x510E527FADE682D1), U(0x9B05688C2B3E6C1F), U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179))
#: Logits are held in this range, so that no exponential leaves the floats.
_FAR = np.float32(60.0)


def deep_code(h: np.ndarray, depth: int) -> np.ndarray:
    """Path of words in the deep classes, as digits of base BRANCH."""
    bits = _SHIFT * (depth - 1)
    spread = mix(h ^ _SALTS[3])
    cls = U(DEEP_FIRST) + (spread >> U(63))
    return ((cls << U(bits)) | (spread & U((1 << bits) - 1))).astype(np.int64)


def placed_code(rank: np.ndarray, depth: int) -> np.ndarray:
    """Path of the words of each rank below PLACED, filled by turns and padded with zeros to ``depth`` digits."""
    code, base = np.zeros(len(rank), np.int64), 0
    for first, n, own in SHORT:
        size = n * BRANCH ** (own - 1)
        here = (rank >= base) & (rank < base + size)
        r = rank[here] - base
        code[here] = (((first + r % n) << (_SHIFT * (own - 1))) + r // n) << (_SHIFT * (depth - own))
        base += size
    return code


def depth_of(code: np.ndarray, depth: int) -> np.ndarray:
    """Number of choices on each path."""
    by_class = np.full(BRANCH, depth)
    for first, n, own in SHORT:
        by_class[first : first + n] = own
    return by_class[code >> (_SHIFT * (depth - 1))]


def _first_node(level: int) -> int:
    """The first class of this level or deeper, as a node of the level."""
    if level == 1:
        return 0
    first = next((first for first, _, own in SHORT if own >= level), DEEP_FIRST)
    return first << (_SHIFT * (level - 2))


_PREFIX = 18


def _prefix_starts(sorted_words: np.ndarray) -> np.ndarray:
    """First of the words whose hash begins with each prefix, or with a later one."""
    return np.searchsorted(sorted_words >> U(64 - _PREFIX), np.arange((1 << _PREFIX) + 1, dtype=U)).astype(np.int32)


def _find(sorted_words: np.ndarray, starts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash among sorted words, -1 where it is not one."""
    prefix = (h >> U(64 - _PREFIX)).astype(np.int64)
    at, end = starts[prefix], starts[prefix + 1]
    out = np.full(len(h), -1, np.int64)
    todo = np.flatnonzero(at < end)
    at = at[todo]
    while len(todo):
        hit = sorted_words[at] == h[todo]
        out[todo[hit]] = at[hit]
        at = at + 1
        more = ~hit & (at < end[todo])
        todo, at = todo[more], at[more]
    return out


@dataclass
class Vocabulary:
    """Counts of frequent words (sorted by hash), the paths of those with leaves of their own, and the biases of all classes."""

    words: np.ndarray
    counts: np.ndarray
    codes: np.ndarray
    placed: np.ndarray
    placed_codes: np.ndarray
    leaf_mass: np.ndarray
    tokens: int
    distinct: int
    depth: int
    bits: int
    bias: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, leaf: np.ndarray, mass: np.ndarray, tokens: int, distinct: int, depth: int) -> Vocabulary:
        """From frequent words with counts (all with a leaf of their own among them), and add-one sums of the deep leaves."""
        order = np.lexsort((words, -counts))[:PLACED]
        own, code = words[order], placed_code(np.arange(len(order)), depth)
        low = DEEP_FIRST << (_SHIFT * (depth - 1))
        leaf_mass = np.zeros(DEEP_CLASSES << (_SHIFT * (depth - 1)))
        leaf_mass[leaf - low] = mass
        leaf_mass[deep_code(np.array([_UNSEEN], U), depth) - low] += 1.0
        every, total = np.concatenate((code, low + np.arange(len(leaf_mass)))), np.concatenate((counts[order] + 1.0, leaf_mass))
        deep = np.concatenate((depth_of(code, depth), np.full(len(leaf_mass), depth)))
        bias = []
        for level in range(1, depth + 1):
            here = deep >= level
            first, at = _first_node(level), every[here] >> (_SHIFT * (depth - level))
            sums = np.bincount(at - (first << _SHIFT), weights=total[here], minlength=(BRANCH**level) - (first << _SHIFT)).reshape(-1, BRANCH)
            sums /= np.maximum(sums.sum(axis=1, keepdims=True), 1e-30)
            bias.append(np.where(sums > 0, np.log(np.maximum(sums, 1e-26)), -_FAR).astype(np.float32))
        codes = deep_code(words, depth)
        codes[order] = code
        by_hash, by_place = np.argsort(words), np.argsort(own)
        bits = min(MAX_BITS, max(MIN_BITS, int(np.log2(max(tokens, 1))) - 5))
        return cls(words[by_hash], counts[by_hash], codes[by_hash], own[by_place], code[by_place], leaf_mass, tokens, distinct, depth, bits, bias)

    def __post_init__(self) -> None:
        self.words_at, self.placed_at = _prefix_starts(self.words), _prefix_starts(self.placed)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the frequent words, -1 where it is not one."""
        return _find(self.words, self.words_at, h)

    def code(self, h: np.ndarray) -> np.ndarray:
        """Path of each word: its own if it has one, else that of its hash."""
        at = _find(self.placed, self.placed_at, h)
        code = deep_code(h, self.depth)
        own = at >= 0
        code[own] = self.placed_codes[at[own]]
        return code

    def mass(self, code: np.ndarray) -> np.ndarray:
        """Add-one count of the leaf at each path of the deep classes."""
        return self.leaf_mass[code - (DEEP_FIRST << (_SHIFT * (self.depth - 1)))]

    def is_deep(self, code: np.ndarray) -> np.ndarray:
        return code >= DEEP_FIRST << (_SHIFT * (self.depth - 1))


@dataclass
class Weights:
    """Rows of weights of the root's features, and of those of all classes below it."""

    root: np.ndarray
    inner: np.ndarray

    @classmethod
    def zero(cls, bits: int) -> Weights:
        return cls(np.zeros((1 << bits, BRANCH), np.float32), np.zeros((1 << bits, BRANCH), np.float32))

    def copy(self) -> Weights:
        return Weights(self.root.copy(), self.inner.copy())


def token_stream(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Over chunks of texts: token, word before, word before that, and row of each token."""
    for _, h, first in rows_of_words(col):
        n = len(first) - 1
        lengths = np.diff(first) + 1
        row = np.repeat(np.arange(n), lengths)
        ends = np.cumsum(lengths)
        token = np.empty(len(h) + n, U)
        is_end = np.zeros(len(token), bool)
        is_end[ends - 1] = True
        token[is_end], token[~is_end] = U(_END), h
        place = np.arange(len(token)) - np.repeat(ends - lengths, lengths)
        one, two = np.roll(token, 1), np.roll(token, 2)
        one[place < 1] = U(_START)
        two[place < 2] = U(_START)
        yield token, one, two, row


def root_rows(one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    """Rows of weights of each position's features at the root."""
    shift = U(64 - bits)
    return np.stack([mix(one ^ _SALTS[0]) >> shift, mix(mix(two * _SALTS[1]) + one) >> shift, mix(two ^ _SALTS[2]) >> shift]).astype(np.int64)


def inner_rows(one: np.ndarray, node: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Rows of weights of the word before with a class of a level below the root."""
    return (mix((one ^ _SALTS[3]) * (node * 8 + level).astype(U) * U(2) + one) >> U(64 - bits)).astype(np.int64)


def _visits(v: Vocabulary, w: Weights, code: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray, int, np.ndarray]]:
    """For each level: (tokens that come there, table, rows of features, tokens' branches, logits)."""
    depth = depth_of(code, v.depth)
    for level in range(1, v.depth + 1):
        branch = (code >> (_SHIFT * (v.depth - level))) & (BRANCH - 1)
        if level == 1:
            rows = root_rows(one, two, v.bits)
            z = np.take(w.root, rows[0], axis=0)
            z += np.take(w.root, rows[1], axis=0)
            z += np.take(w.root, rows[2], axis=0)
            z += v.bias[0][0]
            yield None, w.root, rows, branch, z
            continue
        here = np.flatnonzero(depth >= level)
        if not len(here):
            return
        node = code[here] >> (_SHIFT * (v.depth - level + 1))
        rows = inner_rows(one[here], node, level, v.bits)
        z = np.take(w.inner, rows, axis=0)
        z += np.take(v.bias[level - 1], node - _first_node(level), axis=0)
        yield here, w.inner, rows[None], branch[here], z


def _step(w: np.ndarray, used: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """Moves each row against the sum of its gradients; its rate falls with its use."""
    flat, columns = w.reshape(-1), np.arange(BRANCH)
    np.add.at(used, rows.reshape(-1), 1.0)
    for r in rows:
        rate = (-RATE / np.sqrt(1.0 + used[r])).astype(np.float32)
        np.add.at(flat, ((r * BRANCH)[:, None] + columns).reshape(-1), (g * rate[:, None]).reshape(-1))


def train_on(col: pa.Array, v: Vocabulary, w: Weights, used: tuple[np.ndarray, np.ndarray]) -> None:
    """Gradient steps over all tokens of a column, in batches."""
    ones = np.ones(BRANCH, np.float32)
    for token, one, two, _ in token_stream(col):
        code = v.code(token)
        for lo in range(0, len(token), BATCH):
            s = slice(lo, lo + BATCH)
            for _, table, rows, y, z in _visits(v, w, code[s], one[s], two[s]):
                g = np.exp(np.clip(z, -_FAR, _FAR, out=z), out=z)
                g /= (g @ ones)[:, None]
                g[np.arange(len(y)), y] -= 1.0
                _step(table, used[0] if table is w.root else used[1], rows, g)


def path_score(v: Vocabulary, w: Weights, code: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's path."""
    out, ones = np.empty(len(code)), np.ones(BRANCH, np.float32)
    for lo in range(0, len(code), BATCH):
        s = slice(lo, lo + BATCH)
        total = np.zeros(len(code[s]))
        for here, _, _, y, z in _visits(v, w, code[s], one[s], two[s]):
            np.clip(z, -_FAR, _FAR, out=z)
            p = np.minimum(z[np.arange(len(y)), y] - np.log(np.exp(z) @ ones), 0.0)
            if here is None:
                total += p
            else:
                total[here] += p
        out[s] = total / np.log(10.0)
    return out


def score_column(col: pa.Array, v: Vocabulary, w: Weights) -> Iterator[tuple[np.ndarray, ...]]:
    """Over chunks: per row tokens, known, base and model sums of log10, and (row, hash, unseen) of the tokens beyond the frequent words.

    The sums leave out log10(c + 1) of the tokens that are returned; ``unseen`` is what the
    model's sum changes by if the token turns out to be unseen.
    """
    base_total = np.log10(v.tokens + v.distinct + 1.0)
    unseen_code = deep_code(np.array([_UNSEEN], U), v.depth)
    for token, one, two, row in token_stream(col):
        n = int(row[-1]) + 1
        at = v.find(token)
        frequent = at >= 0
        plus_one = np.zeros(len(token))
        plus_one[frequent] = np.log10(v.counts[at[frequent]] + 1.0)
        code = deep_code(token, v.depth)
        code[frequent] = v.codes[at[frequent]]
        model = path_score(v, w, code, one, two)
        deep = np.flatnonzero(v.is_deep(code))
        # a leaf without a word has no mass: its token is unseen
        model[deep] += plus_one[deep] - np.log10(np.maximum(v.mass(code[deep]), 1.0))
        rare = np.flatnonzero(~frequent)
        instead = path_score(v, w, np.repeat(unseen_code, len(rare)), one[rare], two[rare]) - np.log10(v.mass(unseen_code))
        yield (
            np.bincount(row, minlength=n), np.bincount(row, weights=frequent, minlength=n).astype(np.int64),
            np.bincount(row, weights=plus_one - base_total, minlength=n), np.bincount(row, weights=model, minlength=n),
            row[rare], token[rare], instead - model[rare],
        )


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c): exact counts of the tokens of a column ``text``, by hash; tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> tuple[np.ndarray, np.ndarray]:
            words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return words, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        parts, held = [], 0
        for b in batches:
            for token, *_ in token_stream(b.column(0)):
                parts.append(np.unique(token, return_counts=True))
                held += len(parts[-1][0])
                if held > 2_000_000:
                    parts = [out(parts)]
                    held = len(parts[0][0])
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["word", "c"])
                        parts, held = [], 0
        if parts:
            words, n = out(parts)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "c"])

    return texts.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The frequent words (those above a count that at most TOP_WORDS words reach) and the leaves of all others.

    The driver sees TOP_WORDS words and 2**21 leaves at most.
    """
    level = F.floor(F.log2("c") * 16).cast("int").alias("level")
    levels = counts.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()
    tokens, distinct = sum(r["c"] for r in levels), sum(r["n"] for r in levels)
    taken, least = 0, 1 << 30
    for r in levels:
        if taken + r["n"] > TOP_WORDS:
            break
        taken, least = taken + r["n"], r["level"]
    frequent = F.floor(F.log2("c") * 16).cast("int") >= least
    top = counts.where(frequent).toArrow()
    words, c = top.column("word").to_numpy().view(U), top.column("c").to_numpy()
    depth = DEPTHS[1] if distinct > DEEPER_ABOVE else DEPTHS[0]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, inverse = np.unique(deep_code(b.column(0).to_numpy().view(U), depth), return_inverse=True)
            mass = np.bincount(inverse, weights=b.column(1).to_numpy() + 1.0, minlength=len(code))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(mass)], ["leaf", "mass"])

    rest = counts.where(~frequent).select("word", "c").mapInArrow(leaves, "leaf long, mass double")
    rest = rest.groupBy("leaf").agg(F.sum("mass").alias("mass")).toArrow()
    order = np.lexsort((words, -c))[PLACED:]
    leaf = np.concatenate((rest.column("leaf").to_numpy(), deep_code(words[order], depth)))
    mass = np.concatenate((rest.column("mass").to_numpy(), c[order] + 1.0))
    leaf, inverse = np.unique(leaf, return_inverse=True)
    mass = np.bincount(inverse, weights=mass, minlength=len(leaf))
    return Vocabulary.build(words, c, leaf, mass, tokens, distinct, depth)


def used_rows(start: Weights, mine: Weights, used: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, places in it, uses, weights times uses) of the rows that a task used."""
    for t, (table, n) in enumerate(((mine.root, used[0]), (mine.inner, used[1]))):
        blocks = -(-len(table) // BLOCK_ROWS)
        for k in range(blocks):
            at = np.flatnonzero(n[k * BLOCK_ROWS : (k + 1) * BLOCK_ROWS])
            if len(at):
                rows = at + k * BLOCK_ROWS
                yield t * blocks + k, at.astype(np.uint16), n[rows].astype(np.float32), table[rows] * n[rows, None].astype(np.float32)


def add_rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of (places, uses, weights times uses) of one block."""
    n, total = np.zeros(BLOCK_ROWS), np.zeros((BLOCK_ROWS, BRANCH))
    for at, uses, sums in parts:
        n[at] += uses
        total[at] += sums
    at = np.flatnonzero(n)
    return at.astype(np.uint16), n[at].astype(np.float32), total[at].astype(np.float32)


def averaged(start: Weights, sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Weights:
    """Rows that were used become their average over tasks by use."""
    out = start.copy()
    blocks = -(-len(out.root) // BLOCK_ROWS)
    for k, (at, n, total) in sums.items():
        table = out.root if k < blocks else out.inner
        table[at.astype(np.int64) + (k % blocks) * BLOCK_ROWS] = total / n[:, None]
    return out


def train_round(texts: DataFrame, v: Vocabulary, w: Weights, tasks: int) -> Weights:
    """One round of distributed gradient steps over a column ``text``, by so many tasks at most."""
    sent = texts.sparkSession.sparkContext.broadcast((v, w))
    schema = "block int, part int, at binary, n binary, total binary"

    def row(block: int, part: int, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list:
        return [pa.array([block], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)]

    def sums_of(at: bytes, n: bytes, total: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(at, np.uint16), np.frombuffer(n, np.float32), np.frombuffer(total, np.float32).reshape(-1, BRANCH)

    names = ["block", "part", "at", "n", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, start = sent.value
        mine, used = start.copy(), (np.zeros(len(start.root)), np.zeros(len(start.inner)))
        for b in batches:
            train_on(b.column(0), v, mine, used)
        part = TaskContext.get().partitionId()
        for block, *sums in used_rows(start, mine, used):
            yield pa.RecordBatch.from_arrays(row(block, part, sums), names)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        columns = (table.column(c).to_pylist() for c in ("at", "n", "total"))
        return pa.Table.from_arrays(row(key[0].as_py(), key[1].as_py(), add_rows([sums_of(*x) for x in zip(*columns, strict=True)])), names)

    sums = texts.coalesce(tasks).mapInArrow(run, schema)
    while True:
        tasks = -(-tasks // FAN_IN)
        sums = sums.withColumn("part", F.col("part") % tasks).groupBy("block", "part").applyInArrow(add, schema)
        if tasks == 1:
            break
    found = collected(sums)
    sent.unpersist()
    return averaged(w, {r["block"]: sums_of(r["at"], r["n"], r["total"]) for r in found.to_pylist()})


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, Vocabulary, Weights]:
    """(counts, vocabulary, weights) from all rows of ``train``; each row is in one round."""
    texts = train.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = cut(count_words(texts.select("text")), "word-counts")
    v = vocabulary(counts)
    w = Weights.zero(v.bits)
    tasks = max(4, -(-v.tokens // (max(rounds, 1) * TASK_TOKENS)))
    for k in range(rounds):
        part = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(rounds)) == k
        w = train_round(texts.where(part).select("text"), v, w, tasks)
    return counts, v, w


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, w: Weights, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((v, w))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = sent.value
        for b in batches:
            parts = [[] for _ in range(4)]
            lists, others, offsets = [], [], [np.zeros(1, np.int64)]
            base = 0
            for n_tokens, n_known, base_sum, model, rare_row, rare, unseen in score_column(b.column("text"), v, w):
                for p, x in zip(parts, (n_tokens, n_known, base_sum, model), strict=True):
                    p.append(x)
                lists.append(rare.view(np.int64))
                others.append(unseen.astype(np.float32))
                offsets.append(base + np.searchsorted(rare_row, np.arange(1, len(n_tokens) + 1)))
                base += len(rare)
            if not parts[0]:
                continue
            ends = pa.array(np.concatenate(offsets).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (lists, others)]
            cols = [pa.array(np.concatenate(p)) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("held_out"), *cols, *lists], ["row", "id", "held_out", "n_tokens", "n_known", "base", "model", "rare", "unseen"])

    found = cut(rows.mapInArrow(run, "row long, id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>, unseen array<float>"), "lm-rows")
    tokens = found.select("row", F.explode(F.arrays_zip("rare", "unseen")).alias("z")).groupBy("row", F.col("z.rare").alias("word"))
    tokens = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z.unseen").cast("double")).alias("unseen"))
    plus_one = F.coalesce(F.col("n") * F.log10(F.col("c") + 1), F.lit(0.0))
    exact = tokens.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"), F.sum(plus_one).alias("more"),
        F.sum(F.when(F.col("c").isNull(), F.col("unseen")).otherwise(plus_one)).alias("more_model"),
    )
    joined = found.drop("rare", "unseen").join(exact, "row", "left")
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        F.least(F.col("model") + F.coalesce("more_model", F.lit(0.0)), F.lit(0.0)).alias("score"),
    )


def lm_scores(docs: DataFrame, *, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows, learnt from those whose crc32(id as text) modulo ``folds`` is not ``held``."""
    out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
    counts, v, w = fit(docs.where(~out), id_col=id_col, text_col=text_col)
    return score(docs, counts, v, w, out, id_col=id_col, text_col=text_col)
