"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

N-gram indicators are scaled by the log-count ratios of the two classes, and a linear
hinge-loss model is fitted to them by dual coordinate descent (Hsieh et al., 2008).
N-grams are those of characters and of word shapes; a shape n-gram has one indicator
for each level of its share of the words that it reaches, so that one odd word in a
long text does not look like a text of odd words.

The model is fitted on at most ``max_train`` labelled rows of each class, taken in the
order of a hash of doc_id (the bound is that parameter); scoring reads every text whole.

Defined results: a null text is empty and gets the score of a text without n-grams of
words; without labels every score is 0.5, with labels of one class only the score is
0.99 or 0.01; rows with null labels teach nothing; repeated rows are scored alike; a
null doc_id is not held out. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, pick, utf8

CHAR_BITS, SHAPE_BITS = 16, 12
SIZE = (1 << CHAR_BITS) + (1 << SHAPE_BITS)
LEVELS = (0.0, 0.03, 0.1, 0.3)
GRAM = 4
PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint64)


def shape_of(word: str) -> str:
    """The word with letters as a or A, digits as 0, and runs shortened to one sign."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:12])


class Shapes:
    """Word -> number of its shape, by a memo of bounded size."""

    def __init__(self, limit: int = 300_000) -> None:
        self.limit, self.memo = limit, {}

    def __call__(self, word: str) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            found = self.memo[word] = stable_hash(shape_of(word))
        return found


def stable_hash(text: str) -> int:
    h = 1469598103934665603
    for b in text.encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFF
    return h


def char_features(data: np.ndarray) -> np.ndarray:
    """Hashed character (byte) 4-grams of a text, with repeats."""
    if len(data) < GRAM:
        return np.empty(0, np.int64)
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h += data[k : k + n] * PRIMES[k]
    return ((h ^ (h >> np.uint64(15))) & np.uint64((1 << CHAR_BITS) - 1)).astype(np.int64)


def shape_features(text: str, shapes: Shapes) -> np.ndarray:
    """Indicators of shape unigrams and bigrams by level of share, and of the text's length."""
    words = text.split()
    n = len(words)
    base, size = 1 << CHAR_BITS, 1 << SHAPE_BITS
    length = [base + stable_hash(f"words {n.bit_length()}") % size]
    if not n:
        return np.array(length, np.int64)
    s = np.fromiter(map(shapes, words), np.int64, n)
    keys = np.fromiter(map(hash, words), np.int64, n)
    same = np.flatnonzero(keys[1:] == keys[:-1])
    pairs = (s[:-1] * 31 + s[1:] * 17 + 7) & 0xFFFFFFFF
    pairs[same] = 0x5EED5EED
    grams, counts = np.unique(np.concatenate([s, pairs]), return_counts=True)
    found = [(grams * 2654435761 + 97 * i & 0xFFFFFFFF) // 7 % size for i in range(len(LEVELS))]
    return np.concatenate([length, *(base + f[counts > level * n] for f, level in zip(found, LEVELS, strict=True))])


PIECE = 1 << 16


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text's bytes in pieces that overlap so far that every character n-gram lies in one."""
    for a in range(0, max(len(data) - GRAM + 1, 0), PIECE):
        yield data[a : a + PIECE + GRAM - 1]


def features(data: np.ndarray, text: str, shapes: Shapes) -> np.ndarray:
    return np.unique(np.concatenate([*map(char_features, pieces(data)), shape_features(text, shapes)]))


@dataclass
class Model:
    weights: np.ndarray  # float32[SIZE], log-count ratios already multiplied in
    squares: np.ndarray  # float32[SIZE], squared ratios: a row's length comes from them
    bias: float

    def margins(self, seen: np.ndarray) -> float:
        return float(seen @ self.weights) / max(float(np.sqrt(seen @ self.squares)), 1e-12)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(margin + self.bias, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(SIZE, alpha), np.full(SIZE, alpha)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, beta: float = 0.5, seed: int = 7) -> Model:
    """L1-loss linear SVM by dual coordinate descent on ratio-scaled indicators.

    Each class weighs the same. The weights are pulled towards their mean size by
    1 - beta, as published. Rows are scaled to unit length.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    if len(y) == 0 or abs(y.sum()) == len(y):
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0 if len(y) == 0 else float(y[0]) * 4.6)
    ratio = log_count_ratios(rows, y)
    length = [max(np.sqrt((x := ratio[r]) @ x), 1e-12) for r in rows]
    w, bias = np.zeros(SIZE), 0.0
    share = {1.0: (y > 0).mean(), -1.0: (y < 0).mean()}
    top = np.array([cost / (2 * share[v]) for v in y])
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            r = rows[i]
            x = ratio[r] / length[i]  # not kept: all rows together are most of the driver's memory
            gradient = y[i] * (w[r] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), top[i])  # x·x + 1 for the bias = 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                bias += step
                alpha[i] = new
    mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
    w = (1 - beta) * np.sign(w) * np.minimum(np.abs(w), mean) + beta * w
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(bias))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature rows and labels of the sample: at most max_train rows of each class."""
    known = pick(labels, "doc_id", label).filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    parts = [known.filter(F.col(label) == v).orderBy(order).limit(max_train) for v in (0, 1)]
    sample = parts[0].unionByName(parts[1]).select("doc_id", F.col(label).alias("y"))
    rows = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            data, offs = utf8(column(batch, "text"))
            found = [features(data[a:b], t or "", shapes).tolist() for a, b, t in zip(offs, offs[1:], column(batch, "text").to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "y").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "f"]
            )

    got = rows.mapInArrow(extract, "doc_id long, y int, f array<int>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    flat = [x.values.to_numpy() for x in got.column("f")]  # views of the collected buffers
    return flat, got.column("y").to_numpy().astype(np.int64)


def margins_of(texts: pa.Array, model: Model, shapes: Shapes, seen: np.ndarray) -> np.ndarray:
    """Margins of a column of texts. seen: zeros of SIZE, left as zeros."""
    data, offs = utf8(texts)
    out = np.zeros(len(offs) - 1)
    for i, t in enumerate(texts.to_pylist()):
        part = data[offs[i] : offs[i + 1]]
        for piece in pieces(part):
            seen[char_features(piece)] = 1.0
        seen[shape_features(t or "", shapes)] = 1.0
        out[i] = model.margins(seen)
        seen[:] = 0.0
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text, in the input's partitions: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 x SIZE floats at most, whatever the data

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shapes, seen = shared.value, Shapes(), np.zeros(SIZE, np.float32)
        for batch in batches:
            found = own.score(margins_of(column(batch, "text"), own, shapes, seen))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found)], names=["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(score, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores at least threshold, with all their columns and in the same partitions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shapes, seen = shared.value, Shapes(), np.zeros(SIZE, np.float32)
        for batch in batches:
            yield batch.filter(pa.array(own.score(margins_of(batch.column(at), own, shapes, seen)) >= threshold))

    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return flat.mapInArrow(keep, flat.schema).toDF(*docs.columns)


def quality_table(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 2000) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    rows, y = training_rows(docs, labels, label, max_train)
    out = scored(docs, fit(rows, y))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
