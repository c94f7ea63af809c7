"""A training corpus from the table of documents, stage by stage.

Every stage but the last returns the columns of documents: toxic documents go,
repeated lines go, of near duplicates the one with the smallest doc_id stays,
documents that hold a benchmark item go, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriata.llm.common import table, trim_driver, written
from seriata.llm.decontaminate import contaminated
from seriata.llm.jaccard_join import jaccard_components
from seriata.llm.line_dedup import rewrite_documents
from seriata.llm.packing import pack
from seriata.llm.toxicity import fit, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels of this folder, does not call toxic."""
    trim_driver(spark)
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of a smaller doc_id holds."""
    trim_driver(spark)
    return rewrite_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a similarity of 0.8 of five-word shingles links; rows without doc_id stay."""
    trim_driver(spark)
    groups = jaccard_components(docs, words=5, share=80)
    gone = written(groups.where("component_id < doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    trim_driver(spark)
    gone = written(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    trim_driver(spark)
    # Workers that earlier stages have used keep less: time for memory, the result is the same.
    return pack(docs, cache_bytes=32 << 20, slice_bytes=2 << 20, keep_encoder=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack_documents),
]

#: Fitting a network is beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each one's rows are written before the next reads them."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
