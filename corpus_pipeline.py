"""The corpus pipeline: five stages, each written and read again as the next one's documents.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of
``documents``; a stage that changes ``text`` also renews ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, line_templates, quality_rules, simhash
from sparkloom.llm.queries import ranks_and_pattern
from sparkloom.llm.shared import written

#: No SQL twin: suffix automata, fingerprints' components and BPE are not SQL; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distances reject go."""
    return quality_rules.judge(docs).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but in the first document that has them."""
    return _with_text(line_templates.drop_recurring(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (five words, 0.8 or more) the documents with its smallest id stay.

    Documents without an id stay.
    """
    later = simhash.similar_groups(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items go; the documents stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _with_text(decontaminate.decontaminate(docs, items), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, their count, and whether decoding gives the text back."""
    both = bpe.encode_decode(docs.select("doc_id", "text"), *ranks_and_pattern())
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.decode("bytes", "UTF-8").alias("text"))


def _with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return changed.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
