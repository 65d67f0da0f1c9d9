"""A training corpus from documents, stage by stage; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tidebar.llm.store import delete, scope, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of sf_dir, rejects go.

    Null and empty texts are scored as an empty document and stay; repeated rows are treated alike; without labels of both
    classes, all stay; no rows give no rows. Further columns are dropped.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row of the largest id stays; of repeated rows one; no rows give no rows."""
    return exact_dedup.keep_one(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id. Texts without words, and rows without an id, are in no group and stay; no rows give no rows."""
    return ngram_join.keep_first(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares of their sources (null is one), in a global random order. Sources without text go; repeated rows are drawn alike; no rows give no rows."""
    return mixing.mix(docs).select(*(F.col(f"mix_doc.{c}").alias(c) for c in COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences. Null and empty texts are one end mark; repeated rows are packed as often; no rows give no rows."""
    return packing.pack(docs)


#: Paths of the tables that the stage before wrote on its way, in this thread.
_LEFT: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def _stage(f, first: bool):
    """f as a stage: tables that the stage before wrote on its way go, as its result has been written and read again. Those of the last stage stay, as its result reads them."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            delete(spark, list(_LEFT.get()))
        with scope(spark) as paths:
            out = f(spark, docs, sf_dir)
        _LEFT.set(tuple(paths))
        return out

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing sources", mix_sources), ("best-fit packing", pack)]
STAGES = [(name, _stage(stage, k == 0)) for k, (name, stage) in enumerate(STAGES)]

#: The hashing, training and packing of the stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on documents of sf_dir; each result is written and read again, and goes once the next one is written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if old is not None:
            delete(spark, [old])
        old = docs._tidebar_path
    return STAGES[-1][1](spark, docs, sf_dir)
