"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of a few dozen words.  Every passage is encoded (shares of byte classes, word shapes,
repetitions and hashed byte pairs, then a learned tanh layer); gated attention weighs the passages, tanh(V h) times
sigmoid(U h); the weighted sum is scored.  Labels are of documents alone.  The model is trained in numpy on a bounded,
balanced sample; scoring runs over whole texts on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import BYTE_CODES, NOT_SPACE, Spans, pieces, text_bytes, words
from .common import Scratch, column, crc_mod
from .learning import Adam, labelled_sample, labels_of_fold, sigmoid

#: Words of a passage.
PASSAGE = 48
#: Buckets of hashed byte pairs.
PAIRS = 64
HIDDEN, GATE = 24, 12


def _byte_classes() -> np.ndarray:
    """Each ASCII mark a class of its own, then upper case, lower case, digits, spaces, line ends, other controls, beyond ASCII."""
    out = np.zeros(256, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[marks] = np.arange(len(marks))
    for k, group in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9), (10, 13), [*range(9), 11, 12, *range(14, 32), 127], range(128, 256))):
        out[list(group)] = len(marks) + k
    return out


CLASSES = _byte_classes()
N_CLASSES = int(CLASSES.max()) + 1
N_SHAPES = 7
DIM = N_CLASSES + PAIRS + N_SHAPES


def encode(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row a matrix, passages x DIM; a row without words has one passage of zeros."""
    data, offsets = text_bytes(column)
    for i, j in pieces(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(part, at, NOT_SPACE)
        counts = np.diff(first)
        per = -(-counts // PASSAGE)
        base = np.concatenate([[0], np.cumsum(per)])
        total = int(base[-1])
        if not total:
            yield from (np.zeros((1, DIM)) for _ in range(j - i))
            continue
        row = np.repeat(np.arange(j - i), counts)
        passage = base[row] + (np.arange(len(starts)) - first[row]) // PASSAGE
        size = np.bincount(passage, minlength=total)[:, None]
        # a word's bytes reach to the next word; a row's first one has what stands before it, its last one the rest
        held = counts > 0
        begin, stop = starts.copy(), np.append(starts[1:], len(part))
        begin[first[:-1][held]], stop[first[1:][held] - 1] = at[:-1][held], at[1:][held]
        of_byte = np.repeat(passage, stop - begin)
        inside = part[np.repeat(held, np.diff(at))]
        joined = np.diff(np.repeat(row, stop - begin)) == 0
        length = np.bincount(of_byte, minlength=total)[:, None]
        classes = np.bincount(of_byte * N_CLASSES + CLASSES[inside], minlength=total * N_CLASSES).reshape(total, -1) / length
        pair = (inside[:-1].astype(np.int64) * 31 + inside[1:].astype(np.int64) * 17) % PAIRS
        pairs = np.bincount((of_byte[:-1] * PAIRS + pair)[joined], minlength=total * PAIRS).reshape(total, -1) / length
        long = (ends - starts).astype(float)
        h = Spans(BYTE_CODES[part])(starts, ends)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        order = np.lexsort((h, passage))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        shares = [same, np.bincount(order, fresh, len(h)), long, long * long, (long == 1) * 1.0, (CLASSES[part[starts]] < 32) * 1.0, (CLASSES[part[ends - 1]] < 32) * 1.0]
        shape = np.stack([np.bincount(passage, s, total) for s in shares], 1) / size
        shape[:, 2:4] /= (10, 200)
        made = np.hstack([np.sqrt(classes), np.sqrt(pairs), shape])
        for r in range(j - i):
            yield made[base[r] : base[r + 1]] if per[r] else np.zeros((1, DIM))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]  # W, b, V, U, w, c, c0

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """Scores of bags of standardised passages; ``first`` has each bag's first passage."""
        w, b, v, u, a, c, c0 = self.params
        h = np.tanh(x @ w + b)
        left, right = np.tanh(h @ v), sigmoid(h @ u)
        e = (left * right) @ a
        sizes = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        weight = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(weight[:, None] * h, first)
        return sigmoid(z @ c + c0[0]), z, weight, h, left, right, sizes

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, u, a, c, c0 = self.params
        s, z, weight, h, left, right, sizes = self.forward(x, first)
        d = (s - y) / len(y)
        dz = np.repeat(d[:, None] * c, sizes, 0)
        along = (dz * h).sum(1)
        de = weight * (along - np.repeat(np.add.reduceat(weight * along, first), sizes))
        dleft, dright = de[:, None] * a * right * (1 - left**2), de[:, None] * a * left * right * (1 - right)
        dh = (weight[:, None] * dz + dleft @ v.T + dright @ u.T) * (1 - h**2)
        return [x.T @ dh + 1e-4 * w, dh.sum(0), h.T @ dleft, h.T @ dright, (left * right).T @ de, z.T @ d, np.array([d.sum()])]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
        return self.forward((np.concatenate(bags) - self.mean) / self.scale, first)[0]


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64) -> Model:
    rng = np.random.default_rng(0)
    # one matrix of 32-bit numbers, standardised in place, of which the bags are views
    ends = np.cumsum([len(b) for b in bags])
    all_ = np.concatenate(bags, dtype=np.float32)
    shapes = [(DIM, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    params = [rng.normal(0, 0.1, s) if k not in (1, 6) else np.zeros(s) for k, s in enumerate(shapes)]
    model = Model(all_.mean(0, dtype=np.float64), all_.std(0, dtype=np.float64) + 0.02, params)
    all_ -= model.mean.astype(np.float32)
    all_ /= model.scale.astype(np.float32)
    bags = np.split(all_, ends[:-1])
    adam = Adam(params, 0.005)
    for epoch in range(epochs):
        adam.rate = 0.005 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = [bags[k] for k in order[i : i + batch]]
            first = np.concatenate([[0], np.cumsum([len(b) for b in own])[:-1]])
            adam.step(model.gradient(np.concatenate(own), first, y[order[i : i + batch]]))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, held_out: int = 1, most: int = 2500, most_bytes: int = 16 << 20) -> Model | float:
    """Fit on all passages of at most about ``most`` documents, or ``most_bytes`` of them, of each class.

    The documents are outside the held-out fold and taken whole.  With labels of one class only, that class is returned
    instead of a model; with none, 1.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select("doc_id", "text").where("text <> ''")
    sample, counts = labelled_sample(docs, labels_of_fold(labels, label, mod, held_out).where("y in (0, 1)"), most, most_bytes, scratch, "fit")
    if len(counts) < 2:
        return float(next(iter(counts), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [m.astype(np.float32).tobytes() for m in encode(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "y", "bag"])

    rows = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y int, bag binary").toPandas()
    scratch.drop("fit-labels", "fit-texts")
    if rows["y"].nunique() < 2:
        return float(max(counts, key=counts.get))
    rows = rows.drop_duplicates("bag").sort_values(["doc_id", "bag"])  # the same order in every run
    bags = [np.frombuffer(b, np.float32).reshape(-1, DIM) for b in rows["bag"]]
    return fit(bags, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Model | float, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, 0 to 1, higher for label 1; whole texts, null as empty.

    Repeated rows each return, equal texts with equal scores, and all columns stay, whatever their names; one that is
    called ``out_col`` is replaced.
    """
    if isinstance(model, float):
        return docs.drop(out_col).withColumn(out_col, F.lit(model))

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column_ in columns:
            out, bags, n = [], [], 0
            for m in encode(column_):
                bags.append(m)
                n += len(m)
                if n > 4096:
                    out.append(model.scores(bags))
                    bags, n = [], 0
            yield pa.array(np.concatenate([*out, model.scores(bags)]), pa.float64())

    return docs.drop(out_col).withColumn(out_col, scores(column(text_col)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, by a model of the labels outside the held-out fold.

    Null and empty texts are one passage of zeros and get a score like all others.  Repeated rows and null ids are
    kept; other columns are not read.
    """
    slim = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(slim, train(slim, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
