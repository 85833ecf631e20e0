"""From raw documents to token counts: language ID, line dedup, near duplicates, mixing, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` stores
it as Parquet in the shared folder and reads it back for the next one.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.llm import catalog, jaccard, language, lines
from flowwarden.llm.text import materialize
from flowwarden.plans.session import tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, those without a letter among them; a missing language is filled with the predicted one.

    Null and empty texts are rejected, repeated rows alike; an empty table stays empty.
    """
    tune(spark)
    found = language.identify(docs, catalog.language_model(docs))
    return _documents(found.where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; no document goes.

    A null text stays null with null ``n_chars``, a text that loses all lines becomes empty; an empty table stays empty.
    """
    tune(spark)
    return _documents(lines.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    Rows of one id are one document: the row with the smallest text, language and
    source stays.  Documents without id stay, and so do empty texts, which have no
    near duplicates; an empty table stays empty.
    """
    tune(spark)
    parts = jaccard.jaccard_components(docs)
    stay = parts.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = _documents(docs).join(stay, "doc_id", "left_semi")
    # Rows of one id are combined before they move, so many of them do not meet in one task.
    kept = kept.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d")).select("doc_id", "d.*")
    return _documents(kept).unionByName(_documents(docs.where(F.col("doc_id").isNull())))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them: not at all, once, or once per epoch.

    Null texts and texts without words hold no tokens and go; a null language or
    source is a node of its own; repeated rows count each; an empty table stays empty.
    """
    tune(spark)
    found = catalog.mixed(docs)
    return _documents(found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and of the decoded text, a row per row; a null text counts as empty."""
    tune(spark)
    return catalog.encoded(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

# Language ID, the similarity join and BPE have no SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
