"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination and packing, in that order.

Each stage works on all that the one before it kept, and is written as Parquet and read again, so that a lost executor
costs tasks of one stage only. Empty tables give empty tables, very long texts are worked on whole, and columns of any
other name are carried along. A document that quality rules reject goes; lines that are dropped are gone from the text
that later stages see; of each group of near copies one row, that with the smallest doc_id, stays; a document that holds
a benchmark window goes; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontaminate, fertility, line_dedup, packing, simhash_trie
from engram.llm.stages import materialize
from engram.llm.textbatch import named

#: SQL can't tokenise, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def _others(docs: DataFrame) -> tuple[str, ...]:
    """The columns that an operator only carries: the text travels once."""
    return tuple(c for c in docs.columns if c != "text")


def _whole(docs: DataFrame) -> list:
    return [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands; null and empty texts don't. Repeated rows, null ids and
    other columns stay as they are; very long texts are measured whole."""
    out = fertility.quality_rules(docs, carry=_others(docs)).filter("kept")
    return out.select(*_whole(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that many documents share; n_chars, where there is one, follows the text. Every row
    keeps its own result, also where ids are null or repeat; null texts stay null, very long ones are worked on whole."""
    out = line_dedup.line_dedup(docs, carry=_others(docs)).select(*_whole(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that with the smallest doc_id; a row without doc_id only where no row has one. Texts
    without words are copies of each other; of rows with equal ids and texts one stays. Very long texts count whole."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(named(docs, c).alias(c) for c in docs.columns)).alias("doc")), "rows")
    stay = simhash_trie.representatives(rows.select("row", "doc.doc_id", "doc.text"), "row")
    kept = rows.join(stay.withColumnRenamed("row", "stays").hint("merge"), F.col("row") == F.col("stays"))
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window; a text without words has none. Rows that repeat and rows without
    an id are judged each, very long texts whole."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.decontaminate(docs, benchmark, carry=_others(docs)).filter("not contaminated")
    return out.select(*_whole(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place; a null text is the end id alone. Rows that repeat are
    packed each, very long texts in pieces."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
