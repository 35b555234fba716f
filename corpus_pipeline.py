"""From raw documents to packed sequences: five stages, each one operator of ``tillwise.llm``.

Each stage reads what the one before it kept, written as Parquet in the shared
folder; all but the last return the columns of ``documents``.

Defined results, of every stage
* null texts are empty ones: never poor, toxic, repeated, near or contaminated by
  themselves, they are judged like other texts without words; packing gives them one piece;
* a null id is an id of its own; near copies never drop a row without id;
* repeated rows fall together as far as a stage compares texts, and each is its own
  document where it does not; an empty table goes through all stages to no rows;
* extra columns go through the first four stages as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillwise.llm.common import Scratch, table
from tillwise.llm.decontaminate import drop_contaminated
from tillwise.llm.linededup import dedup_lines
from tillwise.llm.nearcopies import keep_one_of_each
from tillwise.llm.packing import pack_documents
from tillwise.llm.quality import keep_good

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier finds poor or toxic."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete runs of lines that stand in an earlier document; a document that loses all its lines goes."""
    return dedup_lines(docs, emptied=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay the documents end to end in sequences of 2048 ids."""
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]

# Near copies and packing have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``: the packed pieces of the documents that are left."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
