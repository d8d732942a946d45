"""Documents to packed training sequences: five stages, each on all that the one before kept.

Every stage is written as Parquet and read again by the next. All but the last return the columns of
documents, in their order. This file belongs to the subpackage ``llm``.

The filtering stages decide by doc_id: rows of one doc_id go or stay together, also where their texts differ.
Rows without a doc_id are told apart by their texts, so equal ones go together. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygate.llm import decontamination, jaccard_join, packing, pii, quality, queries
from tallygate.llm.shared import Table, split_by_ids, without_ids

#: Keys of rows without a doc_id lie from here on, so that a row with one comes first in its group.
NO_ID = 1 << 62


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column, and its name: the doc_id or, where that is null, a hash of the text from NO_ID on."""
    name, taken = "row_key", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    of_text = F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    return docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), of_text)), name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject.

    A null or empty text is judged as a text without words. Repeated rows share a verdict; a row without a
    doc_id is judged by its text and lends no label.
    """
    rows, key = keyed(docs)
    labels = queries.table(spark, sf_dir, "labels").select(F.col("doc_id").alias(key), "quality")
    scores = quality.quality_scores(rows, labels, id_col=key)
    return without_ids(rows, Table(scores.where("predicted = 0").select("doc_id"), "rejected").df, key).drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a Jaccard similarity of 0.8 or more, the one of least doc_id.

    Null and empty texts are like nothing and stay. Of repeated rows, those of equal doc_id and text, one stays. Where a
    doc_id has several texts, its rows go only if each is like one of a lesser doc_id, so that no component is lost. A row
    without a doc_id goes if its text is like that of a row with one; of such rows alone, one stays.
    """
    rows, key = keyed(docs)
    found = jaccard_join.jaccard_components(rows, id_col=key, words=5, threshold=(80, 100))
    by_id = found.groupBy("doc_id").agg(F.max("component_id").alias("last"), F.count("*").alias("n"))
    told = Table(by_id.where("last < doc_id or n > 1").select(F.col("doc_id").alias(key), "last", "n"), "copies").df
    copies, repeated = told.where(F.col("last") < F.col(key)).select(key), told.where(F.col("last") == F.col(key)).select(key)
    maybe, single = split_by_ids(rows, told.select(key), key)
    kept = maybe.join(copies, key, "left_anti")
    once = kept.join(repeated, key, "left_semi").dropDuplicates([key, "text"])
    return single.unionByName(kept.join(repeated, key, "left_anti")).unionByName(once).drop(key)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item.

    Null and empty texts hold none, null and empty items are held by none. Repeated rows share a verdict; a row without a
    doc_id is judged by its text.
    """
    rows, key = keyed(docs)
    found = decontamination.contaminated(rows, queries.table(spark, sf_dir, "benchmark"), id_col=key)
    return without_ids(rows, Table(found.select("doc_id").distinct(), "leaks").df, key).drop(key)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind; null texts stay null, rows are judged one by one."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null or empty text gives the end token alone; repeated rows and null ids are packed as they are.
    """
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("packing", packed),
]

#: The first and last stages aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
