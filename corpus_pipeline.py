"""The corpus pipeline: five stages over ``documents``.

Each stage takes what the one before has kept (``docs``) and the folder of the tables.
All but the last return the columns of ``documents``; the last returns where each
piece of each document is packed.  Rows without an id pass the stages that need one.  Null and
empty texts are documents like others: the discriminant scores them, those that pass are one group of
near copies, and one of them is packed; an empty table stays empty; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrec.llm import decontaminate, packing, passages, quality_model, simhash
from tallyrec.llm.common import drop_staged, stage, staged_so_far
from tallyrec.llm.queries import table, tokenizer_path


def _with_tie(docs: DataFrame) -> DataFrame:
    """``docs`` with the text's hash, which tells rows of one id with different texts apart."""
    return docs.withColumn("_tie", F.xxhash64(F.coalesce("text", F.lit(""))))


def _without(docs: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows of ``docs`` whose id and text aren't in ``gone (doc_id, _tie)``."""
    return docs.join(gone, ["doc_id", "_tie"], how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant takes for good."""
    return quality_model.good_rows(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one that names the group.

    Of rows that repeat its id within the group, the one with the smallest text hash stays (of equal
    texts, the smallest row); rows of one id in different groups are different documents.
    """
    groups = stage(simhash.near_rows(docs).filter("doc_id is not null").select("doc_id", F.col("tie").alias("_tie"), "root", "component_id"), "groups")
    firsts = groups.filter("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("_tie").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = stage(firsts, "repeated-ids")
    later = groups.join(firsts, ["doc_id", "root"]).filter("_tie <> first").select("doc_id", "_tie")
    others = stage(groups.filter("doc_id <> component_id").select("doc_id", "_tie").unionByName(later).distinct(), "copies")
    # only rows that repeat an id and a text are dealt out to find the first of each
    again = firsts.select("doc_id", F.col("first").alias("_tie")).distinct()
    kept = _without(_with_tie(docs), others)
    row = F.struct(*docs.columns)
    single = _without(kept, again, "left_semi").groupBy("doc_id", "_tie").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return _without(kept, again).select(*docs.columns).unionByName(single)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document keeps."""
    return passages.remove_repeats(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its bin."""
    return packing.pack_documents(docs, tokenizer_path=tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("substrings", substrings), ("benchmarks", benchmarks), ("bins", bins)]
#: The discriminant, SimHash and the latent search can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    mark = staged_so_far()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        drop_staged(spark, mark, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
