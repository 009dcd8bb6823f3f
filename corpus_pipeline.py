"""The corpus pipeline: documents in, a mixed and sharded training set out.

Every stage takes what its predecessor wrote, the columns of documents, and returns the rows that it keeps, in
those columns (the last adds slot and shard).  Some stages train or count, so no SQL states the result: ORACLE_SQL is
None, and the tests hold run() against loops over the rows, stage by stage.

Defined results: an empty table passes through as one, with the last stage's columns; further columns are left out; a row is read whole
however long its text is, and rows with equal ids go through each stage as its docstring says.  Nulls in lang, source and n_chars never
decide on a row, except that a null source is a source of its own in the mixture, and come out as they went in (n_chars is counted anew there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseflow.llm import decontamination, mixing, ngram_join, quality_classifier, sharding
from clauseflow.llm.common import scratch, table
from clauseflow.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: each row by its own text, so repeated rows and rows without id stay or go by it.

    A null or wordless text is scored like any other.  A probability at the threshold is kept; without labels of both kinds all rows are."""
    return quality_classifier.filter_quality(docs.select(COLUMNS), table(ship(spark), sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id.

    Rows with equal ids stay or go together, repeated ones included.  Rows without id come after all that have one; of those with
    one text one is left at most.  Null and wordless texts are copies of nothing and stay."""
    ship(spark)
    return ngram_join.drop_near_copies(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no item of the benchmark: each row by its own text, whatever its id.

    Null, empty and wordless texts repeat nothing and stay, as all rows do if the benchmark is empty."""
    return decontamination.drop_leaks(docs.select(COLUMNS), table(ship(spark), sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Parts of documents, in blocks drawn to the sources' target weights.

    Null, empty and blank texts have no tokens and so no part in any block: they end here.  A null id is carried.  Rows with equal ids
    follow each other in the order of a hash of their tokens, then of the language; repeated rows are all there."""
    ship(spark)
    return mixing.mixed_documents(docs.select(COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the shard that each belongs to. Equal ids share a shard; a null id is placed like the id "null"."""
    ship(spark)
    return sharding.assign_shards(docs.select(COLUMNS))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, name.replace(" ", "-"))
    return docs
