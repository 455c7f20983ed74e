"""The storage layout of a model: long tables in Parquet, partitioned by class and sorted by field.

A hop or a rule names the classes or fields that it reads. With this layout a filter on the class prunes folders, and one
on the field is pushed to the scan, where the sorted row groups are skipped by their minima and maxima. So each use of a
table is one scan of the files that matter, however many sources the model was put together from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_folder
from ..model import ATTRIBUTE, CLASS, CLOSURE, ENTITY, FIELD, PROFILE, RELATION, Model

#: Table -> its columns, and the order inside a file. Those with a class are partitioned by it.
TABLES = {
    "entity": (ENTITY, ["entity_class", "entity_id"]),
    "attr": (ATTRIBUTE, ["entity_class", "attribute_id", "entity_id"]),
    "rel": (RELATION, ["entity_class", "relation_id", "entity_id"]),
    "profile_value": (PROFILE, ["profile_id", "t"]),
}
SCHEMA_TABLES = {"class_def": CLASS, "class_closure": CLOSURE, "field_def": FIELD}


def _folder(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def _read(spark: SparkSession, path: str, name: str, ddl: str) -> DataFrame:
    rows = spark.read.schema(ddl).parquet(_folder(path, name))
    return rows.select(*(c.split()[0] for c in ddl.split(", ")))  # the partition column comes back in its place


#: Into how many parts the rows of one class and field are dealt before they are written.
DEALS = 512
#: Rows of a file. A scan takes files together by size, and each counts for 4 MB at least, so that one task never reads more
#: than 32 of them, however well they are compressed.
FILE_ROWS = 250_000


def write_data(m: Model, path: str) -> None:
    """The tables of entities, values, relations and series. Rows are dealt out by class, field and a part of the ids, so
    that no task sorts a large class alone; the rebalancing joins small parts, and files have an even size."""

    def write(name: str) -> None:
        ddl, order = TABLES[name]
        rows = getattr(m, name).withColumn("_deal", F.pmod(F.xxhash64(order[-1]), F.lit(DEALS)))
        rows = rows.hint("rebalance", *order[:-1], "_deal").drop("_deal").sortWithinPartitions(*order)
        writer = rows.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
        (writer.partitionBy("entity_class") if "entity_class" in ddl else writer).parquet(_folder(path, name))

    with ThreadPoolExecutor(len(TABLES)) as pool:  # four jobs at a time
        list(pool.map(write, TABLES))


def write_stored(m: Model, path: str) -> None:
    """A model in this layout, with its schema: read_stored gives it back."""
    write_data(m, path)
    for name in SCHEMA_TABLES:
        getattr(m, name).coalesce(1).write.mode("overwrite").parquet(_folder(path, name))


def read_stored(spark: SparkSession, path: str) -> Model:
    tables = {name: ddl for name, (ddl, _) in TABLES.items()} | SCHEMA_TABLES
    return Model(**{name: _read(spark, path, name, ddl) for name, ddl in tables.items()})


#: (application, name of the builder) -> (state of what it read, session, model).
_kept: dict[tuple[str, str], tuple[tuple, SparkSession, Model]] = {}


def _state(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Path, length and time of change of each file, so that a changed input is another one."""
    context, found = spark.sparkContext, []
    for p in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(p)
        files = where.getFileSystem(context._jsc.hadoopConfiguration())
        if files.exists(where):
            found += [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in files.listStatus(where)]
    return tuple(sorted(found))


def once(build: Callable[[], Model], name: str, paths: Sequence[str], spark: SparkSession) -> Model:
    """What `build` gives, with its data written in this layout the first time that it is asked for in a session, and
    again where a file of `paths` has changed. The files are in the shared folder and go when the driver ends."""
    key, state = (spark.sparkContext.applicationId, name), _state(spark, paths)
    if key in _kept:
        known, session, m = _kept[key]
        if known == state and session is spark:
            return m
    m = build()
    folder = f"{shared_folder(spark)}/edgeloom-model-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    write_data(m, folder)
    m = m.but(**{t: _read(spark, folder, t, ddl) for t, (ddl, _) in TABLES.items()})
    _kept[key] = state, spark, m
    return m
