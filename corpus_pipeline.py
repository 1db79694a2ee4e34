"""From raw documents to token ids: quality classifier, line dedup, near-dedup, decontamination, encoding.

Each stage takes what its predecessor kept. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import _common as C
from treeledger.llm import decontaminate, line_dedup, near_dup, ordinal_quality, piece_lattice
from treeledger.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects; the others go."""
    return ordinal_quality.select_documents(docs, C.load(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of lines; their n_chars follows the text that is left."""

    out = line_dedup.dedup_lines(docs, pairs=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.decontaminate(docs, C.load(spark, sf_dir, "benchmark"), action="documents")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document: doc_id, lang, source, n_pieces, scores, ids_crc32, decoded,
    n_pieces_each, ids_crc32_each, ids, segmentations (the N best as score and ids)."""
    return piece_lattice.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer("piece_bpe_32k.model")).drop("text")


STAGES = [("quality", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmark), ("pieces", pieces)]

#: SQL expresses neither the classifier nor the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage keeps is stored before the next."""
    docs = C.load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = C.materialize(docs, f"pipeline-{k}")
    return docs
