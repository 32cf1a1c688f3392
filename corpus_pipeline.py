"""The corpus pipeline: five of the numbered operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns rows; they are written as
Parquet and read again as the next one's docs. All but the last return the columns of documents unchanged, extra ones
included, whatever their names; texts of any length are taken whole; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontaminate, mixing, ngram_jaccard, token_store, toxicity
from threadloom.llm.common import Scratch, table
from threadloom.llm.queries import tokenizer_file


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of those present, rejects go.

    Null and empty texts are scored as empty; repeated rows stay or go together; without labels of both kinds all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least id.

    All texts without words, null ones included, are one class; of rows equal in id and text one stays.
    """
    return ngram_jaccard.one_of_each_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go; null and empty texts hold none and stay, as all do without items."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole epochs first; texts without words once; a null source is a source."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all rows, written to the content-addressed store and read back: one row each; null texts have the end alone."""
    return token_store.store_and_read(docs, tokenizer_file())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: Boosted trees, MinHash and byte-pair encoding have no SQL form; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the rows that the stages leave; a stage's table goes when the run ends."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir))
