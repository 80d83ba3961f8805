"""The corpus pipeline: stages that each apply one operator to what the stage before has kept.

Every stage but the last returns the columns of documents. Rows with nulls, empty texts, repeated rows and
extra columns pass through as the operators' own docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import common, decontam, near_dup, pieces, pii, toxicity


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go. The model learns from the labelled rows among docs."""
    return toxicity.drop_toxic(docs, common.read_table(spark, sf_dir, "labels"))


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays."""
    common.ship(spark)
    return near_dup.keep_one(docs)


def benchmark_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which they're more than half go."""
    return decontam.remove_spans(docs, common.read_table(spark, sf_dir, "benchmark"))


def personal_data_is_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets. The field learns from counts over all docs."""
    common.ship(spark)
    return pii.redact(docs)


def texts_become_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the pieces of every text, in chunks that leave room for what earlier stages hold on to."""
    common.ship(spark)
    return pieces.encode(docs, chunk_bytes=CHUNK_BYTES)


#: Text in a chunk of the encoding stage.
CHUNK_BYTES = 4_000_000

STAGES = [
    ("toxicity", toxic_documents_go),
    ("near_duplicates", near_copies_go),
    ("decontamination", benchmark_passages_go),
    ("personal_data", personal_data_is_masked),
    ("sentencepiece", texts_become_pieces),
]

#: SQL can't express the learned stages and the encoding; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written as Parquet and read again as the next one's docs."""
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs)
    return docs
