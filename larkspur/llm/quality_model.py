"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams, scaled by the log-count ratio of the two classes; a linear
hinge-loss model is fit on them by dual coordinate descent, and a logistic curve over its margins gives
scores from 0 to 1. Besides words, the n-grams are of word shapes, in which a word that equals the one
before it is a shape of its own: what makes a text bad is seldom its vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.labelled import SAMPLE_BYTES, labelled_texts, learnt_in_one_task
from larkspur.llm.storage import bounded, own_names, plain_names, trimmed
from larkspur.llm.textkit import WHITESPACE, chunks, find_words, mix

#: Hashed features.
BITS = 18
#: Most labelled rows of each class that are learnt from, chosen by a hash of their ids. Each is learnt from whole.
SAMPLE = 2000
#: Bytes of the sample whose n-grams are found at once, about: finding them takes some hundred times that.
LEARNT_AT_ONCE = 1 << 18

_LOWER, _UPPER, _DIGIT, _POINT, _SIGN, _WIDE, _SAME = range(1, 8)
_SHAPE = np.full(256, _SIGN, dtype=np.uint8)
_SHAPE[[*range(0x61, 0x7B)]] = _LOWER
_SHAPE[[*range(0x41, 0x5B)]] = _UPPER
_SHAPE[[*range(0x30, 0x3A)]] = _DIGIT
_SHAPE[[ord(c) for c in ".,;:!?'\"()-"]] = _POINT
_SHAPE[0x80:] = _WIDE


def ngram_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct n-grams of each text, text by text.

    Word n-grams of 1 and 2, lower-cased, and shape n-grams of 1 to 3. A shape tells which kinds of
    characters a word begins and ends with, which it has at all, and how long it is, roughly.
    """
    words = find_words(data, offsets, WHITESPACE, lower=True)
    texts = len(offsets) - 1
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = _SHAPE[data]
    hashes = words.hashes()
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    has = np.zeros(len(hashes), dtype=np.uint64)
    for kind in (_UPPER, _DIGIT, _POINT, _SIGN):
        seen = np.concatenate(([0], np.cumsum(kinds == kind)))
        count = seen[words.end] - seen[words.start]
        has = has * np.uint64(3) + np.minimum(count, 2).astype(np.uint64)
    length = np.minimum(np.log2(words.end - words.start + 1).astype(np.uint64), np.uint64(5))
    shape = (kinds[words.start].astype(np.uint64) * np.uint64(8) + kinds[words.end - 1]) * np.uint64(81) + has
    shape = np.where(same, np.uint64(1 << 20), shape * np.uint64(6) + length)
    out_doc, out = [], []
    for base, sizes, salt in ((hashes, (1, 2), 11), (mix(shape), (1, 2, 3), 23)):
        for n in sizes:
            at = np.flatnonzero(words.doc[: len(words.doc) - n + 1] == words.doc[n - 1 :])
            total = np.full(len(at), salt + n, dtype=np.uint64)
            for j in range(n):
                total = mix(total ^ base[at + j])
            out_doc.append(words.doc[at])
            out.append((total >> np.uint64(64 - BITS)).astype(np.int64))
    key = np.concatenate(out_doc) * (1 << BITS) + np.concatenate(out)
    key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    """A weight for each feature (ratios included), and the logistic curve over margins."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = ngram_features(data, offsets)
        texts = len(offsets) - 1
        norm = np.sqrt(np.maximum(np.bincount(doc, minlength=texts), 1))
        return np.bincount(doc, self.weights[feature], minlength=texts) / norm + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.shift, -40, 40)))


class _Scaled(Sequence):
    """(feature numbers, values) of each of some examples, made when asked for: its ratios divided by the example's norm, and 1 for the last, the bias."""

    def __init__(self, features: list[np.ndarray], some: np.ndarray, ratio: np.ndarray):
        self.features, self.some, self.ratio = features, some, ratio

    def __len__(self) -> int:
        return len(self.some)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.features[self.some[k]]
        v = self.ratio[at] / np.sqrt(max(1, len(at) - 1))
        v[-1] = 1.0
        return at, v


def dual_coordinate_descent(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, cost: np.ndarray, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum cost * max(0, 1 - y w.x), one dual variable at a time, in random order.

    rows: (feature numbers, values) of each example.
    """
    w, alpha, rng = np.zeros(width), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([float(v @ v) for _, v in rows])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            if not square[i]:
                continue
            gradient = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _logistic(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, by Newton steps on smoothed targets (Platt's method)."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g, h = np.array([((p - target) * margins).sum(), (p - target).sum()]), p * (1 - p)
        hess = np.array([[(h * margins * margins).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(features: Iterable[np.ndarray], label: np.ndarray, smoothing: float = 1.0, penalty: float = 4.0) -> Model:
    """The model of examples given as arrays of distinct feature numbers; classes weigh the same in the sum of losses."""
    width = 1 << BITS
    # one feature more, always 1, for the bias
    features = [np.append(f, width).astype(np.int32) for f in features]

    def ratios(some: np.ndarray) -> np.ndarray:
        counts = [np.full(width, smoothing), np.full(width, smoothing)]
        for i in some:
            counts[label[i]][features[i][:-1]] += 1
        return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    def learn(some: np.ndarray) -> tuple[np.ndarray, float]:
        r = ratios(some)
        rows = _Scaled(features, some, np.append(r, 1.0))
        share = np.bincount(label[some], minlength=2) / len(some)
        w = dual_coordinate_descent(rows, np.where(label[some] == 1, 1.0, -1.0), width + 1, penalty * 0.5 / np.maximum(share[label[some]], 1e-9))
        return w[:width] * r, float(w[width])

    everyone = np.arange(len(features))
    if len(np.unique(label)) < 2:
        only = float(label[0]) if len(label) else 0.5
        return Model(np.zeros(width), 0.0, 1.0, float(np.log((only + 0.05) / (1.05 - only))))
    margins = np.zeros(len(features))
    folds = everyone % 3
    for k in range(3):  # margins of examples not learnt from, for the curve
        w, bias = learn(everyone[folds != k])
        for i in everyone[folds == k]:
            margins[i] = w[features[i][:-1]].sum() / np.sqrt(max(1, len(features[i]) - 1)) + bias
    w, bias = learn(everyone)
    return Model(w, bias, *_logistic(margins, label))


def learn(texts: pa.Array, label: np.ndarray) -> Model:
    """The model of labelled texts."""
    return fit(_features_of(texts), label)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of at most `sample` labelled texts of each class and sample_bytes of both, those whose ids hash lowest, each learnt from whole.

    Which rows are left out, and what counts where ids or labels are repeated, labelled_texts() says. With labels of one class, or
    none, also of empty tables, every text gets the same score. One task holds the sample: its texts, and 4 bytes for
    each distinct n-gram of a text.
    """
    rows, _ = labelled_texts(docs, labels, id_column, text_column, label_column, sample, sample_bytes)
    return learnt_in_one_task(bounded(rows), learn)


def _features_of(column: pa.Array) -> Iterator[np.ndarray]:
    for low, high, data, offsets in chunks(column, LEARNT_AT_ONCE):
        doc, feature = ngram_features(data, offsets)
        first = np.searchsorted(doc, np.arange(high - low + 1))
        yield from (feature[a:b] for a, b in zip(first[:-1], first[1:]))


def _score(model, text: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for low, high, data, offsets in chunks(batch.column(text)):
                scores[low:high] = model.value.scores(data, offsets)
            columns = [c for k, c in enumerate(batch.columns) if k != text]
            names = [n for k, n in enumerate(batch.schema.names) if k != text]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*names, name])

    return run


def score_texts(docs: DataFrame, model, text_column: str = "text", columns: list[str] | None = None, score_column: str = "score") -> DataFrame:
    """The given columns of docs (all by default), each row once, repeated ones too, and score_column (double, 0 to 1).

    model: anything with scores(bytes, offsets); its size doesn't depend on docs. Null and empty texts get a score too, and
    a very long text is scored whole. A column of docs that is named as score_column is left out for the score; name
    another to keep it. An empty table gives an empty result.
    """
    columns = [c for c in columns or docs.columns if c.lower() != score_column.lower()]
    plain, of = plain_names(docs)
    kept = {c: of[c] for c in columns}
    rows = plain.select(*kept.values(), F.col(of[text_column]).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    scored = bounded(rows).mapInArrow(trimmed(_score(docs.sparkSession.sparkContext.broadcast(model), len(columns), "score")), schema)
    return own_names(scored, kept | {score_column: "score"})


def held_out(id_column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))
