"""A corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark passages go, personal data is
masked, and what is left is packed into token sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import decontamination, jaccard, packing, private_data, toxicity
from fleetgauge.llm.common import held_out, let_go_of_caches, let_go_of_heaps, let_go_of_shuffles, staged, table
from fleetgauge.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rested(stage: Stage) -> Stage:
    """The stage, begun after executors let go of what the one before it kept on disk and left in their heaps."""
    @wraps(stage)
    def run_rested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_go_of_shuffles(spark)
        let_go_of_heaps(spark)
        return stage(spark, docs, sf_dir)
    return run_rested


def rested_workers(stage: Stage) -> Stage:
    """The same, with what is kept in Python workers; for stages that use these themselves."""
    @wraps(stage)
    def run_rested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_go_of_caches(spark)
        return rested(stage)(spark, docs, sf_dir)
    return run_rested


@rested_workers
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    learn = lambda rows: rows.filter(~held_out(F.col("doc_id")))
    model = toxicity.train(learn(docs), learn(table(spark, sf_dir, "labels")))
    return toxicity.classify(docs, model).filter("toxic_predicted = 0").select(*docs.columns)


@rested_workers
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the least id; documents without words stay."""
    return jaccard.deduplicated(docs).select(*docs.columns)


@rested_workers
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also none with other numbers, names or units in it.

    What is left to do on the frame returned needs no Python, so workers let go here: the next stage runs on DataFrame functions only.
    """
    clean = decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    let_go_of_caches(spark)
    return clean


@rested
def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span replaced by its kind; n_chars follows the text."""
    # Named first: inside a lambda, `text` would mean the new column of the same projection.
    found = private_data.find(docs).withColumn("_masked", private_data.masked(F.col("text"), F.col("spans")))
    changed = {"text": F.col("_masked")} | ({"n_chars": F.length("_masked").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.withColumns(changed).select(*docs.columns)


@rested_workers
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens; a null text is empty."""
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0)
    return rows.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids"), F.col("width")).alias("ids_crc32"),
                       "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic), ("near_copies", without_near_copies), ("benchmark", without_benchmark),
    ("private_data", without_private_data), ("packing", packed)]

#: SQL cannot state the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
