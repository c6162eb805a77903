"""Cleaning a corpus in five stages, each on all that the one before kept.

Quality classifier, exact dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece encoding. A stage takes
(spark, docs, sf_dir); its result is written as Parquet and read back as the next one's documents. All but the last return the
columns of `documents`; the last one returns doc_id, ids and the text that they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from asofkit.llm.common import broadcast_if_small, free_name, materialise, row_key, table, text_name
from asofkit.llm.decontaminate import contamination, with_verdict
from asofkit.llm.exact_dedup import first_rows
from asofkit.llm.jaccard import similar_groups
from asofkit.llm.quality import quality_scores
from asofkit.llm.sentencepieces import decode_documents, encode_documents

# The near stage links texts by five-word shingles and a similarity of 0.8 or more; op9's contract (3 words, 0.9) is its own.
NEAR_SHINGLE, NEAR_SHARE = 5, 80

ORACLE_SQL = None  # a trained classifier and a tokenizer have no SQL; tests hold the stages against brute force


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`docs` less the rows with the id and the text of one of `rows`; NULL ids match NULL."""
    own, name = free_name(docs, "gone"), free_name(docs, "name")
    gone = materialise(rows.select(row_key().alias(own), F.col("text_name").alias(name)).distinct())
    return docs.join(broadcast_if_small(gone), (row_key() == F.col(own)) & (text_name() == F.col(name)), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A NULL text is judged as an empty one, equal rows alike; an empty table stays empty."""
    return _without(docs, quality_scores(docs, table(spark, sf_dir, "labels"), named=True).where("predicted = 0"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case, NULL as empty) one row stays, that with the largest id; a NULL id is the smallest."""
    return first_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays; of NULL or repeated ids, the one with the smallest hash. Texts without words stay."""
    return _without(docs, similar_groups(docs, shingle=NEAR_SHINGLE, share=NEAR_SHARE, named=True).where("not first"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words inside benchmark windows go; NULL and empty texts have no words and stay."""
    return _without(docs, with_verdict(contamination(docs, table(spark, sf_dir, "benchmark"), named=True)).where("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text they decode to of every row that is left, repeated ones each; a NULL text gives no ids and an empty text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return decode_documents(materialise(encode_documents(docs, path)), path)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("sentencepiece", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return materialise(STAGES[-1][1](spark, docs, sf_dir))
