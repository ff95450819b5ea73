"""Bounded samples of labelled documents, and a small Adam optimiser for models trained in numpy on the driver."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod

_SCALE = 1 << 20
#: Texts of each class that are taken however many bytes they have.
LEAST = 20


def labels_of_fold(labels: DataFrame, label: str, mod: int, held_out: int) -> DataFrame:
    """(doc_id, y) of rows outside the held-out fold; of repeated ids the largest label, null labels and ids left out."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", mod) != held_out))
    return rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def thin(df: DataFrame, id_col: str, rows: int, most: int, salt: int) -> DataFrame:
    """About ``most`` of ``rows`` rows, chosen by a hash of the id: the same ones in every run and on every cluster."""
    share = min(1.0, most / max(1, rows))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(_SCALE)) < int(share * _SCALE))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int, scratch: Scratch, name: str, classes: tuple[int, ...] = (0, 1)) -> tuple[DataFrame, dict[int, int]]:
    """Documents (doc_id, text) with y, and the classes' counts in all labels.

    Of each of ``classes`` at most about ``most`` different texts are taken, and so few that whole texts of about ``most_bytes``
    are, but ``LEAST`` of them where there are that many: no class is lost.  Ids that repeat in ``docs`` bring no more.
    Rows are chosen by a hash, and none is cut.
    """
    labels = scratch.save(labels, f"{name}-labels")
    counts = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not any(y in counts for y in classes):
        return docs.join(labels, "doc_id").where("false"), counts
    chosen = reduce(DataFrame.unionByName, [thin(labels.where(F.col("y") == y), "doc_id", n, most, 7) for y, n in counts.items() if y in classes])
    # about 2 x ``most`` pairs of numbers: a bounded broadcast
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("y", "text").agg(F.min("doc_id").alias("doc_id"))
    found = scratch.save(found.withColumn("_draw", F.xxhash64("text")), f"{name}-texts")
    held = found.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    share = {r["y"]: max(r["n"] / (1.2 * most), r["size"] / most_bytes) for r in held}
    number = {r["y"]: r["n"] for r in held}

    def part(y: int) -> DataFrame:
        own = found.where(F.col("y") == y)
        if share[y] <= 1:
            return own
        if number[y] / share[y] < 2 * LEAST:  # so few that a share of them might be none
            return own.orderBy(F.xxhash64("_draw"), "text").limit(LEAST)
        return thin(own, "_draw", round(share[y] * 1000), 1000, 13)

    return (reduce(DataFrame.unionByName, map(part, share)) if share else found).drop("_draw"), counts


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
