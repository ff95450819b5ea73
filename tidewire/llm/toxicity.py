"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, labels unseen, is the unlabelled set.  First,
each word and word beginning gets the log ratio of its rate among positives to its rate among negatives, the latter
from the unlabelled rate less the class prior's share of positives.  Then a logistic model over what a text's most
telling words say is trained by the non-negative risk: prior x loss(positives as toxic) + max(0, loss(unlabelled as
clean) - prior x loss(positives as clean)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import BYTE_CODES, WORD_BYTES, Spans, ascii_lower, mix64, pieces, text_bytes, words
from .common import Scratch, column, crc_mod
from .learning import Adam, labelled_sample, labels_of_fold, sigmoid, thin

#: Bytes of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: A feature needs so large a log ratio to be kept, and so many positive documents: ``LEAST``, or one of ``SHARE``, so
#: that a document's features, on average, times ``SHARE`` bound how many there are.
LEAST, SHARE, RATIO = 5, 2000, 1.5
N_SUMMARY = 6


@dataclass
class Model:
    tokens: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # their log ratios
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray  # of the summary, and the intercept


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: their number, a matrix of feature hashes (words x features), and each row's first word."""
    codes = BYTE_CODES[ascii_lower()]
    letters = WORD_BYTES.copy()
    letters[65:91] = True
    data, offsets = text_bytes(column)
    for i, j in pieces(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = words(part, offsets[i : j + 1] - offsets[i], letters)
        spans = Spans(codes[part])
        with np.errstate(over="ignore"):
            cols = [spans(starts, ends)] + [mix64(spans(starts, np.minimum(ends, starts + p)) + np.uint64(p)) for p in PREFIXES]
        yield j - i, np.stack(cols, 1), first


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, pos, unl): in how many positive and unlabelled documents of (y, text) a feature occurs; y is 1 or 0."""

    def counts(seen: list[np.ndarray], labels: list[int]) -> pa.RecordBatch:
        tokens, at = np.unique(np.concatenate(seen), return_inverse=True)
        positive = np.repeat(np.array(labels, float), [len(t) for t in seen])
        pos = np.bincount(at, positive, len(tokens)).astype(np.int64)
        unl = np.bincount(at, 1 - positive, len(tokens)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(pos), pa.array(unl)], ["token", "pos", "unl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_pylist()
            done = 0
            # a run of texts of about a megabyte at a time, so that memory does not follow the batch
            for n, tokens, first in _features(batch.column(1)):
                seen = [np.unique(tokens[first[r] : first[r + 1]]) for r in range(n)]
                yield counts(seen, y[done : done + n])
                done += n

    counted = docs.select("y", "text").mapInArrow(run, "token bigint, pos bigint, unl bigint")
    return counted.groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))


def summaries(column: pa.Array, tokens: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the most telling words of each text say: the best weight, the sums of two and four, strong words, length."""
    out = []
    for n, hashes, first in _features(column):
        if len(tokens) and len(hashes):
            at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
            own = np.where(tokens[at] == hashes, weights[at], 0).max(1)
        else:
            own = np.zeros(len(hashes))
        ids = hashes[:, 0]
        for r in range(n):
            a, b = first[r], first[r + 1]
            told = np.flatnonzero(own[a:b] > 0) + a
            _, once = np.unique(ids[told], return_index=True)
            w = np.sort(own[told[once]])[::-1]
            out.append([w[:1].sum(), w[:2].sum(), w[:4].sum(), np.log1p((w > 4).sum()), np.log1p((own[told] > 4).sum()), np.log1p(b - a)])
    return np.array(out, float).reshape(-1, N_SUMMARY)


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 400) -> np.ndarray:
    """Coefficients and intercept that make the non-negative positive-unlabelled risk small, by the sigmoid loss."""
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u = one(positive), one(unlabelled)
    coef = np.zeros(p.shape[1])
    coef[:-1] = 0.1
    adam = Adam([coef], 0.05)
    for _ in range(epochs):
        sp, su = sigmoid(p @ coef), sigmoid(u @ coef)
        # the loss of calling x toxic is 1 - s, of calling it clean s; both have slope s (1 - s)
        dp, du = (sp * (1 - sp)) @ p / len(p), (su * (1 - su)) @ u / len(u)
        negative = su.mean() - prior * sp.mean()
        grad = -prior * dp + (du - prior * dp) if negative >= 0 else -(du - prior * dp)
        adam.step([grad + 1e-4 * np.append(coef[:-1], 0)])
    return coef


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, held_out: int = 0, most: int = 12_000, most_bytes: int = 128 << 20) -> Model | None:
    """Fit on at most about ``most`` positives, or ``most_bytes`` of them, and twice as many unlabelled rows.

    All are whole texts outside the held-out fold.  The class prior is the share of positives among the fold's labels.  None if there are no positives.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    docs = docs.select("doc_id", "text").where("text <> ''")
    sample, counts = labelled_sample(docs, labels_of_fold(labels, label, mod, held_out).where("y in (0, 1)"), most, most_bytes, scratch, "pu", (1,))
    if not counts.get(1):
        return None
    prior = min(0.9, max(0.005, counts[1] / sum(counts.values())))
    open_ = docs.where(crc_mod("doc_id", mod) != held_out)
    unlabelled = thin(open_.withColumn("_draw", F.xxhash64("doc_id", "text")), "_draw", docs.count(), 2 * most, 11)
    both = sample.select("y", "text").unionByName(unlabelled.select(F.lit(0).alias("y"), "text"))
    both = scratch.save(both.dropDuplicates(["y", "text"]), "sample")
    size = {r["y"]: r["n"] for r in both.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_unl:
        return None
    p, u = F.col("pos") / n_pos, F.col("unl") / n_unl
    negative = F.greatest((u - prior * p) / (1 - prior), F.lit(0.0))
    ratio = F.log((p + 0.5 / n_pos) / (negative + 2.0 / n_unl))
    support = max(LEAST, n_pos // SHARE)
    rows = token_counts(both).where(F.col("pos") >= support).withColumn("w", ratio).where(F.col("w") >= RATIO).select("token", "w").toPandas()
    tokens, weights = rows["token"].to_numpy(np.int64).astype(np.uint64), rows["w"].to_numpy(float)
    order = np.argsort(tokens)
    tokens, weights = tokens[order], weights[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = summaries(batch.column(1), tokens, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s[:, i]) for i in range(N_SUMMARY)]], ["y", *[f"f{i}" for i in range(N_SUMMARY)]])

    schema = "y int, " + ", ".join(f"f{i} double" for i in range(N_SUMMARY))
    told = both.select("y", "text").mapInArrow(run, schema).toPandas().to_numpy(float)
    scratch.drop("sample", "pu-labels", "pu-texts")
    told = told[np.lexsort(told.T)]  # the same order in every run
    x = told[:, 1:]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    return Model(tokens, weights, mean, scale, nnpu(x[told[:, 0] == 1], x[told[:, 0] == 0], prior))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, 0 to 1, higher for the toxic; whole texts, null as empty.  0 for all without a model.

    Repeated rows each return, equal texts with equal scores, and all columns stay, whatever their names; one that is
    called ``out_col`` is replaced.
    """
    if model is None:
        return docs.drop(out_col).withColumn(out_col, F.lit(0.0))

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column_ in columns:
            s = (summaries(column_, model.tokens, model.weights) - model.mean) / model.scale
            yield pa.array(sigmoid(np.hstack([s, np.ones((len(s), 1))]) @ model.coef), pa.float64())

    return docs.drop(out_col).withColumn(out_col, scores(column(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, by a model of the labels outside the held-out fold.

    Null and empty texts are scored as texts without words (clean).  Repeated rows and null ids are kept; other
    columns are not read.  Without positives every score is 0.
    """
    slim = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(slim, train(slim, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
