"""The corpus pipeline: every stage reads all that the one before it kept, from Parquet.

documents -> toxicity -> exact_dedup -> near_dedup -> suffix_dedup -> packing. All stages but the last
return the columns of documents; n_chars follows a text that was cut. The last returns one row for
each packed piece. A stage can be run again from its predecessor's table if executors are lost.

Stages hand texts to Python in small batches (BATCH, set in the session, as the caller writes the
result): an executor keeps the memory that its largest batch took. A stage's result is to be written before the next stage is called, which deletes the intermediate
tables of those before it, except where its own input still reads them.

Defined results: null and empty texts and repeated rows pass the toxicity stage by the score of a text
without terms, then are one document by exact dedup (rows equal in text, the smallest doc_id, nulls
last, stays); near dedup and suffix dedup leave texts without words, or under 200 bytes, alone, and a
text of any length is handled whole; packing gives each document that is left at least its end id.
Further columns are carried along by all stages but packing. Empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.llm import exact_dedup, minhash_dedup, packing, suffix_dedup
from provgraph.llm import toxicity as tox
from provgraph.llm.common import delete, scope, table, written

#: Rows, and bytes, handed to Python at a time. Results don't depend on them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: Intermediate tables of the stages run so far, still to be deleted.
_TABLES: list[str] = []


def _clear(spark: SparkSession, docs: DataFrame) -> None:
    """Deletes the tables of earlier stages that docs doesn't read."""
    names = {path: "/" + path.rpartition("/")[2] + "/" for path in _TABLES}
    read = {path for path, name in names.items() if any(name in f for f in docs.inputFiles())} if names else set()
    delete(spark, [path for path in names if path not in read])
    _TABLES[:] = list(read)


def _stage(function: Callable) -> Callable:
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark, docs)
        for key, value in BATCH.items():
            spark.conf.set(key, value)
        with scope(spark, _TABLES):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't reject."""
    return tox.accepted(docs, table(spark, sf_dir, "labels"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside."""
    return exact_dedup.drop_copies(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash_dedup.keep_one(docs)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages of 200 bytes or more."""
    out = suffix_dedup.keep_first(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in the packed sequences."""
    return packing.packed_plan(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", passages), ("packing", pack)]

#: SQL can express neither the learnt stage nor the hashed ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scope(spark, after := []):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        delete(spark, before)
        before = after
    _clear(spark, docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
