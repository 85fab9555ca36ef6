"""A corpus from documents: language, near-duplicates, benchmark passages, secrets, packing.

Stages decide row by row: rows that share an id, or have none, are each judged by their own text. Columns may
have any names; all stages but the last return the columns of their input. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.llm import decontaminate, jaccard_join, language_id, packing, queries, secret_scan
from rulespan.session import Scratch

#: The library can't express compression, tokenizers or a forest in SQL.
ORACLE_SQL = None


def _languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; fitted on the labelled rows of ``docs``.

    Null texts, texts without letters, and texts whose margin is too narrow go. Without any label all go.
    """
    dictionaries, margins = language_id.fit(docs)
    return language_id.keep_accepted(docs, dictionaries, margins)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that of least id, null ids last; of equal ids any one.

    Rows that repeat an id and text are copies like others. Null texts and texts without words link with
    nothing, and all stay. Rows get numbers in a written table, so that each is one row throughout.
    """
    scratch = Scratch(spark, "numbered")
    rows = scratch.put(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = jaccard_join.link_components(spark, rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "__row")).alias("least")
    kept = rows.select("doc_id", "__row").join(found, "__row").groupBy("component_id").agg(least).select(F.col("least.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def _decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of an item of ``benchmark``. Null texts stay; ties and repeated items change nothing."""
    return decontaminate.drop_leaks(spark, docs, queries.table(spark, sf_dir, "benchmark"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` set anew. Null texts and others without a secret stay as they are."""
    return secret_scan.redact(spark, docs)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, from every row; a null text is an empty one."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), 2)


STAGES = [
    ("language_id", _languages),
    ("jaccard_join", _near_duplicates),
    ("decontamination", _decontaminated),
    ("secret_scan", _secrets),
    ("packing", _packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again, but the last."""
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
