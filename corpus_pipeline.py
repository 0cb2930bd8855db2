"""A corpus pipeline of five stages over ``documents``; counted as part of the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import contamination, language, near_copies, pieces, quality
from ledgerlens.llm.common import fold, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined and accepted; texts without a letter, and texts in no learned language, go."""
    models = language.learn(docs.where(fold("doc_id", 4) != 2))
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    clashing = {c: f"__{c}" for c in keep if c in ("lang_pred", "score", "entropy", "accepted")}
    held = docs.withColumnsRenamed(clashing)
    judged = language.identify(held, models, keep=("text", *(clashing.get(c, c) for c in keep)))
    kept = judged.where("accepted").drop("lang_pred", "score", "entropy", "accepted")
    return kept.withColumnsRenamed({v: k for k, v in clashing.items()}).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good."""
    labels = table(spark, sf_dir, "labels")
    outside = fold("doc_id", 3) != 1
    model = quality.learn(docs.where(outside), labels.where(outside))
    return quality.good_rows(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, then wording; ids may repeat over texts."""
    return near_copies.kept(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return contamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's token ids, their count and digest, and the digest of the text that they decode to."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: Models and hashes of the stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
