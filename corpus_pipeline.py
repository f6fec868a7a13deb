"""A training-text pipeline: language, toxicity, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes what a stage returns as Parquet in the shared folder and reads it again
for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathflow.llm import jaccard, langid, queries, toxicity
from pathflow.llm.shared import free_name, written

#: Least score with which a document's predicted language counts as recognised; of four languages chance gives 0.25.
LEAST_LANGUAGE_SCORE = 0.45
#: Score from which a document is toxic.
TOXIC_SCORE = 0.5
#: Near duplicates share this percentage of their shingles of this many words.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def keep_recognised_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the network doesn't recognise: no letters, or a score below the least.

    Where no document names its language there is no network, and all documents with a letter stay.
    """
    network = langid.train_on(docs, learn=f"{queries.remainder(3)} <> 1")
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name(docs.columns, "__lang_pred"), free_name(docs.columns, "__lang_score")
    judged = langid.predict_languages(docs, network, into=(lang, score), keep=tuple(docs.columns))
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(lang, score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier calls toxic."""
    model = toxicity.train_on(docs, queries.table(spark, sf_dir, "labels"), learn=f"{queries.remainder(5)} <> 0")
    score = free_name(docs.columns, "__toxic_score")
    return toxicity.score_texts(docs, model, into=score, keep=tuple(docs.columns)).where(F.col(score) < TOXIC_SCORE).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates keep the document of the smallest doc_id; documents without words are no duplicates."""
    found = jaccard.jaccard_components(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)
    goes = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(goes, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in windows of 2048 ids."""
    return queries.pack_documents(docs)


STAGES = [
    ("language ID", keep_recognised_languages),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("packing", pack),
]

#: SQL can express neither the trained stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
