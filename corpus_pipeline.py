"""The corpus pipeline: toxicity, quality, near-duplicates, benchmark passages, piece encoding.

Each stage works on all documents that the one before it kept, and is written and read again in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, neardup, quality, sentencepieces, toxicity
from tidewire.llm.common import Scratch, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity, by a model of the labels outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "_score")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < 0.5).drop(score)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for quality, by a model of the labels outside the held-out fold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "_score")
    return quality.score(docs, model, out_col=score).where(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows that repeat an id and a text stay together; a row goes only if one with a smaller id is linked with its own
    text, so a row without an id goes only if one with an id is.
    """
    return neardup.without_copies(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item, or a whole shorter item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, a digest of the piece ids, whether they decode to the text, and the ids themselves."""
    coded = sentencepieces.encode_checked(docs)
    digest = F.sha2(F.array_join("token_ids", ",").cast("binary"), 256)
    return coded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), "round_trip", "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: The first two stages train models; SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, f"{i}-{name}")
    return docs
