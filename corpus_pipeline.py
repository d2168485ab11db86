"""A corpus from raw documents: quality rules, exact, near and substring deduplication, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm import exact_dedup, minhash, packing, quality, repeats
from quireworks.llm.common import Workspace, bound_batches, recording, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Working tables of the stage that ran last, by Spark application.
_open: dict[str, list[Workspace]] = {}


def _closing(stage: Stage) -> Stage:
    """Closes the working tables of the stage before: its result has been written, and ``docs`` reads what was written.

    Tables that ``docs`` still reads itself stay.  One pipeline runs at a time in an application.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        app = spark.sparkContext.applicationId
        bare = lambda path: path.split(":", 1)[-1].lstrip("/")
        read = [bare(path) for path in docs.inputFiles()]
        for ws in _open.pop(app, []):
            if not any(path.startswith(bare(ws.root) + "/") for path in read):
                ws.close()
        with recording() as opened:
            out = stage(spark, docs, sf_dir)
        _open[app] = opened
        return out

    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    bound_batches(spark)
    # a pipeline starts: tables that an earlier one's result may still read are left alone
    _open.pop(spark.sparkContext.applicationId, None)
    model = quality.fit_model(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, "_qw_verdict").filter("_qw_verdict.kept").select(docs.columns)


@_closing
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts stays."""
    return exact_dedup.drop_copies(docs)


@_closing
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.drop_near_copies(docs)


@_closing
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of about 50 words (repeats.PASSAGE bytes) that repeat leave the texts."""
    return repeats.remove_repeats(docs, repeats.PASSAGE).withColumn("n_chars", F.length("text").cast("long"))


@_closing
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts in sequences of at most 4096 tokens."""
    found = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(Workspace(spark, "pieces").save(found, "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("packing", pack_sequences),
]

#: Trees, consistent sampling and a tokenizer are beyond SQL: tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(before, "saved_path"):
            ws.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
