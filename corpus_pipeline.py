"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

1. ``toxicity``: documents that the classifier rejects go.
2. ``near_dedup``: one document of each group of near-duplicates stays.
3. ``decontaminate``: documents that hold a passage of the benchmark go.
4. ``mix``: documents are taken as often as their source's target asks.
5. ``tokens``: documents become rows of token ids in the token store's files.

All but the last return the columns of documents.

Defined cases, beyond those of the operators: a null text is an empty one, is
kept by the first stage if the classifier's bias accepts it and by the next
two, and adds no words to the mix; null ids, sources and languages are carried
along; repeated rows are copies, of which the second stage keeps one; very long
texts pass every stage whole; an empty table gives no rows; other columns,
whatever their names, keep their values up to the fourth stage.

A stage's own tables are deleted once its result is written, so a run leaves
the results of its stages and the token files in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontam, mixing, near_dedup, token_store, toxicity
from glyphmill.llm.common import scoped, scratch, table


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write(docs, path)
    return token_store.read(spark, path).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", keep_clean),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", keep_uncontaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Not expressible in SQL: the toxicity stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with scoped(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
