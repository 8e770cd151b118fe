"""The corpus pipeline: five stages over documents, each written and reread.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last
return the columns of ``documents``; the last adds each document's place in a
batch. Further columns pass through, whatever their names (the last stage
replaces those that it adds); rows with nulls pass as each operator states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.llm import decontam, linededup, minhash, packing, quality
from ringside.llm.common import held_out, save, ship, table

#: Documents that score lower are rejected; the bar of the quality query's prediction.
LEAST_QUALITY = 0.7


def _beside(docs: DataFrame, added: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work``'s rows with the columns of ``docs``. Those named as ``work``
    names what it adds are set aside meanwhile."""
    aside = {c: f"_pipeline_{c}" for c in docs.columns if c.lower() in added}
    out = work(docs.withColumnsRenamed(aside)).drop(*added)
    return out.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns quality from the labels of the documents at hand (held-out rows
    excepted) and drops the documents that score under LEAST_QUALITY."""
    ship(spark)
    rows = save(quality.measured(docs.select("doc_id", "text")), "measured")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", F.col("quality").alias("y"))
    model = quality.train(rows.join(labels, "doc_id"))
    return _beside(docs, ("score",), lambda d: quality.score_texts(d, model).filter(F.col("score") >= LEAST_QUALITY))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of recurring templates; n_chars follows the text."""
    counted = lambda d: linededup.dedup_lines(d).withColumn("n_chars", F.char_length("text").cast("long"))
    return _beside(docs, ("n_lines", "n_dropped"), counted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    ship(spark)
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each document in a batch of its length bucket."""
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", pack)]

#: Boosted tables, template trees, minwise joins and the boundaries' dynamic
#: programme are no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
