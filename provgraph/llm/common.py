"""Helpers that several operators share: written intermediate tables, row ids, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"

#: Open scopes, innermost last: the paths of the tables written within each.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a local session names none, as in tests."""
    folder = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SHARED} to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(SHARED, folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors.

    result: the table outlives the scope it is written in, for what the operator returns is read from it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    depth = len(_SCOPES) - 1 - result
    if depth >= 0:
        _SCOPES[depth].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def scope(spark: SparkSession, tables: list[str] | None = None) -> Iterator[list[str]]:
    """Tables written within it, results aside, are deleted at its end; with a list given they are only noted there."""
    _SCOPES.append([] if tables is None else tables)
    try:
        yield _SCOPES[-1]
    finally:
        own = _SCOPES.pop()
        if tables is None:
            delete(spark, own)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, actions hand n rows at a time to Python: wide rows stay small in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, df: DataFrame) -> str:
    """A column name near the given one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Rows of a few numbers up to which a table is broadcast, some megabytes; a larger one is shuffled.
SMALL = 150_000


def sized(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, with a broadcast hint if it was counted to be small."""
    return F.broadcast(df) if df.count() <= most else df


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """Connected components of undirected links: (node, root), root being the component's smallest node.

    Every node has a parent, at first its smallest neighbour. In a round, the smallest grandparent among a
    node's neighbours is handed to the node and to its parent, and each node jumps to its grandparent, so
    that rounds grow with the logarithm of a chain. It ends when no parent changes: then all nodes of a
    component have one. Every round is joins and partial aggregates, its results written tables, so
    nothing is gathered on the driver; only whether rows changed comes back.
    """
    with scope(spark):
        both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
        both = written(both.union(both.select("other", "node")).where("node <> other").distinct(), "links")
        hint = F.broadcast if both.count() <= SMALL else (lambda df: df)
        label = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "roots")
        for _ in range(rounds):
            up = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
            high = label.join(hint(up), "root")
            seen = both.join(hint(high.select(F.col("node").alias("other"), "above")), "other").groupBy("node").agg(F.min("above").alias("near"))
            step = written(seen.join(hint(high), "node").select("node", "root", "above", "near"), "near")
            handed = step.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("handed"))
            step = step.join(hint(handed), "node", "left").select("node", F.col("root").alias("was"), F.least("root", "above", "near", "handed").alias("root"))
            step = written(step, "roots")
            label = step.select("node", "root")
            if step.where("was <> root").isEmpty():
                return written(label, "components", result=True)
    raise RuntimeError(f"components: labels still change after {rounds} rounds")


def leading(df: DataFrame, score: str, k: int, steps: int = 16) -> DataFrame:
    """The k rows of the largest positive scores, and few more: those above a bar that a histogram of log scores sets.

    A plain top-k sends k rows of every partition to the driver; behind the bar about k rows are left in all.
    """
    step = F.floor(F.log2(F.greatest(F.col(score), F.lit(1e-9))) * steps).alias("step")
    counts = sorted(((r["step"], r["n"]) for r in df.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, bar = 0, None
    for bar, n in counts:
        total += n
        if total >= k:
            break
    return df if bar is None or total < k else df.where(F.floor(F.log2(F.greatest(F.col(score), F.lit(1e-9))) * steps) >= bar)
