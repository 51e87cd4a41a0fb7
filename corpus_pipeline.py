"""The corpus pipeline: documents through five training-data operators.

``STAGES`` is for callers that write each stage's rows and read them again; ``run`` does the same in
one call and keeps what lies between two stages in the cluster's checkpoint folder. Stages pass on
every column of their documents, whatever it is called, and tell rows apart by all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm import mixing, ngram_join, quality, queries, toxicity
from cadastra.llm.common import durable, table

#: Near-duplicates and mixing have no SQL form, and the classifiers are fitted.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one column ``doc`` beside its text, so that no name of a column is in an operator's way."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier predicts as toxic; null texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_whole(docs), model, id_columns=("doc",)).where("predicted = 0").select("doc.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the documents that pass the base rules and the trees."""
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(_whole(docs), forest, id_columns=("doc",)).where("kept").select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of n-gram links: that of the smallest id. Repeated rows count as copies."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # a row's name is its id and 128 bits of all its columns
    row = F.struct("doc_id", F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns))
    marked = docs.select(F.struct(*columns).alias("doc"), row.alias("row"), F.col("text"))
    linked = ngram_join.link(marked, id_column="row")
    # rows without words are linked with nothing
    stays = linked.where(F.col("row") == F.col("component_id")).select("row").distinct()
    kept = marked.select("doc", "row").join(stays, marked["row"].eqNullSafe(stays["row"]), "left_semi")
    # rows equal in all columns are one
    return kept.groupBy("row").agg(F.first("doc").alias("doc")).select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the number of copies that the target mix draws for them, in mixed order."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "source")
    return mixing.shuffled(mixing.mix(whole)).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places; each copy of a document is packed."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("n-gram near-duplicates", near_duplicate_stage),
    ("source mix", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            df = durable(df)
    return df
