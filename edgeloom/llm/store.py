"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where the session has none, a new one if driver and executors are
    one process (tests), else an error: on a cluster each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: With this setting Spark deletes the shuffle files of a query as soon as it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Folders written in each scratch() that is open, innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: the lineage ends here, and a lost executor costs
    no recomputation of what came before. The files go with the scratch() around it, else when the driver's JVM ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/edgeloom-{uuid.uuid4().hex}"
    seen = Observation()
    with _tidy(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/{name}")
    if _open:
        _open[-1].append(folder)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.stored_rows = seen.get["rows"]  # counted as they were written, so that nothing has to read them for it
    return out


def size(table: DataFrame) -> int:
    """The rows of a table; of a stored one without a job."""
    known = getattr(table, "stored_rows", None)
    return table.count() if known is None else known


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is stored inside is deleted at the end, but for what the yielded function stores."""
    own: list[str] = []
    _open.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        _open.pop()
        try:
            return stored(df, name)
        finally:
            _open.append(own)

    try:
        yield keep
    finally:
        _open.pop()
        context = spark.sparkContext
        for folder in own:
            where = context._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a few numbers each that may be broadcast: at most 100 MB in memory.
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has at most BROADCAST_ROWS rows; a larger one is joined by shuffling."""
    return F.broadcast(table) if size(table) <= BROADCAST_ROWS else table


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows: a worker never holds more whole texts than that."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (string, null as empty); other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
