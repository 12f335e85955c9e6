"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs one
word apart, in ``2**bits`` coordinates, each with value 1; words end at white space
or ASCII punctuation and A-Z are lower-cased.  FTRL keeps a learning rate for each
coordinate, and its L1 term leaves most weights at exactly zero, so the model that is
broadcast holds only the rest (never more than ``2**bits`` floats).

Defined cases: a null or empty text has no features and scores the bias alone; very
long texts are scored whole; repeated rows are scored each; an empty table gives no
rows; without training rows every score is 0 (to 15 digits), for nothing is shown to be
toxic.  Rows of one id are one training row, by the smallest of their features and the
largest of their labels.  Extra columns are carried through untouched; only a column
with the name asked for the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernel import U, WHITE_OR_PUNCTUATION, mix, rows_of_words

#: Scores are of logits in this range.
_FAR = 35.0
_PAIR, _SKIP = U(0x8CB92BA72F3D8DD7), U(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class FtrlParams:
    """``max_rows``: bound of the sample of labelled rows, taken in the order of a hash of their ids."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 14.0
    l2: float = 0.5
    epochs: int = 4
    max_rows: int = 16_384
    positive_weight: float = 2.0


@dataclass(frozen=True)
class FtrlModel:
    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray
    n_rows: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float64)
        w[self.index] = self.weight
        return w


def features(col: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Over chunks: (rows, row of each feature, coordinate of each feature), with repeats."""
    shift = U(64 - bits)
    for _, h, first in rows_of_words(col, separators=WHITE_OR_PUNCTUATION):
        n = len(first) - 1
        row = np.repeat(np.arange(n), np.diff(first))
        parts = [(row, h)]
        for gap, salt in ((1, _PAIR), (2, _SKIP)):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                parts.append((row[:-gap][same], mix(h[:-gap] * salt + h[gap:])[same]))
        yield n, np.concatenate([r for r, _ in parts]), (np.concatenate([x for _, x in parts]) >> shift).astype(np.int64)


def fit_ftrl(rows: list[tuple[np.ndarray, int]], p: FtrlParams) -> tuple[float, np.ndarray]:
    """(bias, weights) after ``epochs`` passes over (distinct coordinates, label) rows in the order given."""
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(zi: np.ndarray, ni: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for idx, y in rows:
            i = np.append(idx, size)
            l1 = np.full(len(i), p.l1)
            l1[-1] = 0.0
            zi, ni = z[i], n[i]
            w = weights(zi, ni, l1)
            g = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -_FAR, _FAR))) - y) * (p.positive_weight if y else 1.0)
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[i] = ni + g * g
    w = weights(z, n, np.append(np.full(size, p.l1), 0.0))
    return float(w[-1]), w[:-1]


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FtrlModel:
    """Fit on at most ``params.max_rows`` labelled rows; the caller leaves held-out labels out.

    The sample's ids are broadcast (``max_rows`` bounds them).  Scan, join and features are
    parallel, rows of one id are combined before the shuffle, and one task then makes the
    passes, which FTRL's sequence asks for, over no more than ``max_rows`` rows.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    y = y.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    y = y.orderBy(F.xxhash64("__id"), "__id").limit(params.max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(y), "__id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for n, row, idx in features(b.column(1), params.bits):
                order = np.argsort(row, kind="stable")
                at, idx = np.searchsorted(row[order], np.arange(n + 1)), idx[order]
                got += [np.unique(idx[at[i] : at[i + 1]]).astype("<u4").tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(got, pa.binary()), b.column(2)], ["id", "x", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, examples = [], []
        for b in batches:
            x = b.column("x")
            offsets, data = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1], x.buffers()[2]
            # views of the batch: the sample is held once
            examples += [(np.frombuffer(data, "<u4", (hi - lo) // 4, lo) if hi > lo else np.zeros(0, "<u4"), y) for lo, hi, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), b.column("y").to_pylist(), strict=True)]
            ids.append(b.column("id").to_numpy())
        order = np.argsort(mix(np.concatenate(ids).astype(U)), kind="stable") if ids else []
        examples = [examples[i] for i in order]
        if not examples:
            return
        bias, w = fit_ftrl(examples, params)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([bias, float(len(examples)), *w[at].tolist()], pa.float64())], ["i", "w"]
        )

    sample = rows.mapInArrow(extract, "id long, x binary, y int").groupBy("id").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    fitted = sample.repartition(1).mapInArrow(fit, "i long, w double").toArrow()
    i, w = fitted.column("i").to_numpy(), fitted.column("w").to_numpy()
    if not len(i):
        return FtrlModel(params.bits, -_FAR, np.zeros(0, np.int64), np.zeros(0), 0)
    return FtrlModel(params.bits, float(w[i == -1][0]), i[i >= 0], w[i >= 0], int(w[i == -2][0]))


def score(docs: DataFrame, model: FtrlModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and the probability of the label 1 for each row's whole text."""
    kept = [c for c in docs.columns if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weight))
    bits, bias = model.bits, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << bits)
        w[shared.value[0]] = shared.value[1]
        for b in batches:
            out = []
            for n, row, idx in features(b.column(len(kept)), bits):
                used = np.flatnonzero(w[idx])
                pair = np.unique((row[used] << bits) | idx[used])
                total = np.bincount(pair >> bits, weights=w[pair & ((1 << bits) - 1)], minlength=n) + bias
                out.append(1.0 / (1.0 + np.exp(-np.clip(total, -_FAR, _FAR))))
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(values, pa.float64())], [*kept, score_col])

    schema = docs.select(*kept).schema.add(score_col, "double")
    return docs.select(*kept, F.col(text_col).cast("string").alias("__crestline_text")).mapInArrow(run, schema)


def fold(id_col: str, n: int):
    """crc32 of the id's text, modulo n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(0))


def toxicity(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(), *, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each document; labels are learnt from the rows of the other folds."""
    model = train(docs, labels.where(fold(id_col, folds) != 0), params, id_col=id_col, text_col=text_col)
    scored = score(docs.select(id_col, text_col), model, text_col=text_col, score_col="score")
    return scored.select(
        id_col, (fold(id_col, folds) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
