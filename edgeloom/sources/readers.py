"""Models and profiles from files. Everything but schemas and descriptors is read by Spark."""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import safe_double, to_bool
from ..functions.text import split_targets
from ..model import ATTRIBUTE, RELATION, Model

ENTITY_COLUMNS = ("entity_class", "entity_id")


def _values(rows: DataFrame) -> DataFrame:
    """ATTRIBUTE rows of rows with entity_class, entity_id, attribute_id, value_str and perhaps unit, provenance_ref."""
    have = rows.columns
    text = F.col("value_str")
    null = F.lit(None).cast("string")
    optional = lambda c: (F.nullif(F.col(c), F.lit("")) if c in have else null).alias(c)
    out = rows.where(text.isNotNull() & (text != ""))
    return out.select(*ENTITY_COLUMNS, "attribute_id", "value_str", safe_double(text).alias("value_num"), to_bool(text).alias("value_bool"), optional("unit"), optional("provenance_ref"))


def _edges(rows: DataFrame) -> DataFrame:
    """RELATION rows of rows with entity_class, entity_id, relation_id and `targets`, a text or a list."""
    listed = F.col("targets") if dict(rows.dtypes)["targets"].startswith("array") else split_targets(F.col("targets"))
    return rows.select(*ENTITY_COLUMNS, "relation_id", F.posexplode(listed).alias("ord", "target_id")).select(*ENTITY_COLUMNS, "relation_id", "target_id", "ord")


def placed(rows: DataFrame) -> DataFrame:
    """With `seq`, the load order of rows that a file source gives: files by name, then the place in the file. It is
    taken before any shuffle from where a row lies, so it is the same each time."""
    paths = sorted(re.sub("^file:/+", "file:/", f) for f in rows.inputFiles())  # as file_path has them
    files = rows.sparkSession.createDataFrame(list(enumerate(paths)), "file_no long, file string")
    at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    out = rows.select("*", F.col("_metadata.file_path").alias("file"), at.alias("place")).join(F.broadcast(files), "file", "left")
    return out.withColumn("seq", F.coalesce("file_no", F.lit(0)) * (1 << 46) + F.col("place")).drop("file", "place", "file_no")


def _with(m: Model, ids: DataFrame, attr: DataFrame, rel: DataFrame, library: bool = False) -> Model:
    """The model with what was read. An entity's `seq` is that of its first row in `ids`."""
    seq = F.min("seq").alias("seq")
    entity = ids.groupBy(*ENTITY_COLUMNS).agg(seq).select(*ENTITY_COLUMNS, F.lit(library).alias("is_library"), "seq")
    return m.but(entity=m.entity.unionByName(entity), attr=m.attr.unionByName(attr), rel=m.rel.unionByName(rel))


def read_rows(m: Model, ids: DataFrame, values: DataFrame, edges: DataFrame, library: bool = False) -> Model:
    """The model with rows that are long already: ids (entity_class, entity_id, seq), values (entity_class, entity_id,
    attribute_id, value_str, unit, provenance_ref) and edges (entity_class, entity_id, relation_id, target_id, ord)."""
    return _with(m, ids, _values(values), edges.select(*ENTITY_COLUMNS, "relation_id", "target_id", "ord"), library)


def unknown_fields(m: Model, rows: DataFrame, name: str) -> DataFrame:
    """Rows whose field `name` the class does not have."""
    known = m.field_def.select(F.col("class_name").alias("entity_class"), F.col("field_id").alias(name))
    return rows.join(F.broadcast(known), ["entity_class", name], "left_anti")


#: The class in a path: `<Class>.csv`, or a folder `entity_class=<Class>` as Spark writes it.
CLASS_OF_FILE = r"(?:entity_class=([^/]+)/[^/]+|([^/]+?)(?:\.csv)?)$"


def read_narrow_csv(m: Model, folder: str) -> Model:
    """A file `<Class>.csv`, or a folder `entity_class=<Class>`, for each class: entity_id, attribute, value, relation;
    `__exists__` rows only name an entity."""
    found = m.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder, header=True, escape='"')
    path = F.col("_metadata.file_path")
    found = found.withColumn("entity_class", F.coalesce(*(F.nullif(F.regexp_extract(path, CLASS_OF_FILE, k), F.lit("")) for k in (1, 2))))
    rows = placed(found)
    values = rows.where("attribute is not null and attribute <> '' and attribute <> '__exists__'").select(*ENTITY_COLUMNS, F.col("attribute").alias("attribute_id"), F.col("value").alias("value_str"))
    edges = rows.where("relation is not null and relation <> ''").select(*ENTITY_COLUMNS, F.col("relation").alias("relation_id"), F.col("value").alias("targets"))
    return _with(m, rows, _values(values), _edges(edges))


def _unpivoted(rows: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return rows.select(*ENTITY_COLUMNS, F.explode(cells).alias("c")).select(*ENTITY_COLUMNS, "c.field", "c.value").where("value is not null and value <> ''")


def read_wide_csv(m: Model, folder: str, classes: list[str], meta: bool = False) -> Model:
    """A file `<Class>.csv` with a column for each field; with `meta`, also `<a>__unit` and `<a>__prov`."""
    parts = []
    for c in classes:
        rows = placed(m.spark.read.csv(f"{folder}/{c}.csv", header=True, escape='"').withColumn("entity_class", F.lit(c)))
        known = {(f["kind"], f["field_id"]) for f in m.field_def.where(F.col("class_name") == c).select("kind", "field_id").collect()}
        attributes = [x for x in rows.columns if ("attribute", x) in known]
        relations = [x for x in rows.columns if ("relation", x) in known]
        more = lambda x, end: F.col(f"`{x}{end}`") if meta and x + end in rows.columns else F.lit(None)  # noqa: E731, B023
        cells = [F.struct(F.lit(a).alias("attribute_id"), F.col(f"`{a}`").alias("value_str"), more(a, "__unit").cast("string").alias("unit"), more(a, "__prov").cast("string").alias("provenance_ref")) for a in attributes]
        values = rows.select(*ENTITY_COLUMNS, F.explode(F.array(*cells)).alias("c")).select(*ENTITY_COLUMNS, "c.*") if cells else None
        parts.append((rows.select(*ENTITY_COLUMNS, "seq"), values, _unpivoted(rows, relations).toDF(*ENTITY_COLUMNS, "relation_id", "targets") if relations else None))
    for ids, values, edges in parts:
        attr = _values(values) if values is not None else m.spark.createDataFrame([], ATTRIBUTE)
        m = _with(m, ids, attr, _edges(edges) if edges is not None else m.spark.createDataFrame([], RELATION))
    return m


def read_hierarchical_csv(m: Model, folder: str, entity_class: str, prefixes: dict[str, str]) -> DataFrame:
    """`<Class>_wide.csv` as rows entity_class, entity_id, view (by the prefix before the first dot), field, value."""
    rows = m.spark.read.csv(f"{folder}/{entity_class}_wide.csv", header=True).withColumn("entity_class", F.lit(entity_class))
    long = _unpivoted(rows, [c for c in rows.columns if c not in ENTITY_COLUMNS])
    names = m.spark.createDataFrame(list(prefixes.items()), "prefix string, view string")
    dotted = F.col("field").contains(".")
    parts = long.select(*ENTITY_COLUMNS, "value", F.when(dotted, F.split_part("field", F.lit("."), F.lit(1))).alias("prefix"), F.when(dotted, F.regexp_replace("field", r"^[^.]*\.", "")).otherwise(F.col("field")).alias("field"))
    return parts.join(F.broadcast(names), "prefix", "left").select(*ENTITY_COLUMNS, "view", "field", "value")


LONG = ("entity_class", "entity_id", "attribute_id", "attribute_value", "attribute_unit", "attribute_provenance", "relation_type", "relation_id")


def read_long_csv(m: Model, path: str) -> Model:
    rows = placed(m.spark.read.csv(path, header=True, escape='"'))
    missing = [c for c in LONG if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    values = rows.where("attribute_id is not null").select(*ENTITY_COLUMNS, "attribute_id", F.col("attribute_value").alias("value_str"), F.col("attribute_unit").alias("unit"), F.col("attribute_provenance").alias("provenance_ref"))
    edges = rows.where("relation_type is not null").select(*ENTITY_COLUMNS, F.col("relation_type").alias("relation_id"), F.col("relation_id").alias("targets"))
    return _with(m, rows, _values(values), _edges(edges))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1, as an editor counts) and value of the lines of one text file that is read in splits: the lines of each
    split are counted, and the counts summed up over the splits before it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("n"))
    counts = rows.groupBy("split").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = F.sum("lines").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "split").select((F.col("before") + F.col("n") - F.col("first") + 1).alias("line"), "value")


def long_csv_unknowns(m: Model, path: str) -> DataFrame:
    """line, entity_class, entity_id, kind (class, attribute or relation) and name of what the rows of a long CSV name and
    the schema does not know. A row of an unknown class is named once, for its class."""
    header = m.spark.read.csv(path, header=True, escape='"').columns
    text = ", ".join(f"`{c}` string" for c in header)
    lines = numbered_lines(m.spark, path).where("line > 1 AND trim(value) <> ''")
    rows = lines.select("line", F.from_csv("value", text, {"escape": '"'}).alias("r")).select("line", "r.*")
    classes = F.broadcast(m.class_def.select(F.col("class_name").alias("entity_class"), F.lit(True).alias("known")))
    rows = rows.join(classes, "entity_class", "left")
    out = rows.where("known IS NULL").select("line", *ENTITY_COLUMNS, F.lit("class").alias("kind"), F.col("entity_class").alias("name"))
    for kind, column in (("attribute", "attribute_id"), ("relation", "relation_type")):
        named = rows.where(F.col("known") & (F.col(column) != "")).select("line", *ENTITY_COLUMNS, F.lit(kind).alias("kind"), F.col(column).alias("name"))
        fields = m.field_def.where(F.col("kind") == kind).select(F.col("class_name").alias("entity_class"), F.col("field_id").alias("name"))
        out = out.union(named.join(F.broadcast(fields), ["entity_class", "name"], "left_anti").select("line", *ENTITY_COLUMNS, "kind", "name"))
    return out


def read_json(m: Model, path: str, library: bool = False) -> Model:
    """A JSON model, read in splits; all targets of a relation are kept."""
    from .hierarchical import read_document

    return read_document(m, path, "json", library)


def read_yaml(m: Model, path: str, library: bool = False) -> Model:
    """A YAML model, read in splits."""
    from .hierarchical import read_document

    return read_document(m, path, "yaml", library)


def read_parquet_long(m: Model, path: str) -> tuple[Model, DataFrame]:
    """The model, and the profiles in `__values__` rows. Relations stand in rows with a `relation` and their targets."""
    rows = placed(m.spark.read.parquet(path))
    profiles = rows.where("attribute = '__values__'").select(F.col("entity_id").alias("profile_id"), F.posexplode("values").alias("t", "value"))
    optional = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("unit", "provenance_ref")]
    values = rows.where("attribute <> '__values__' AND attribute <> '__exists__'").select(*ENTITY_COLUMNS, F.col("attribute").alias("attribute_id"), F.col("value").alias("value_str"), *optional)
    edges = m.spark.createDataFrame([], RELATION)
    if "targets" in rows.columns:
        edges = _edges(rows.where("relation IS NOT NULL").select(*ENTITY_COLUMNS, F.col("relation").alias("relation_id"), "targets"))
    return _with(m, rows, _values(values), edges), profiles


def read_profiles_wide(spark: SparkSession, path: str) -> DataFrame:
    """(profile_id, t, value) of a table with timestamp_index and a column for each profile."""
    rows = spark.read.parquet(path)
    cells = F.array(*(F.struct(F.lit(c).alias("profile_id"), F.col(f"`{c}`").cast("double").alias("value")) for c in rows.columns if c != "timestamp_index"))
    out = rows.select(F.col("timestamp_index").cast("int").alias("t"), F.explode(cells).alias("c"))
    return out.select("c.profile_id", "t", "c.value").where("value is not null")


def read_datapackage(m: Model, folder: str) -> Model:
    """The resources of a datapackage.json, one wide CSV for each class. An id of two classes is an error."""
    described = json.loads(m.spark.read.text(f"{folder}/datapackage.json", wholetext=True).first()[0])
    known = {r["class_name"] for r in m.class_def.select("class_name").collect()}
    classes = [name for r in described["resources"] if (name := str(r["path"]).split("/")[-1].removesuffix(".csv")) in known]
    out = read_wide_csv(m, folder, classes)
    clash = out.entity.groupBy("entity_id").agg(F.count_distinct("entity_class").alias("n")).where("n > 1").orderBy("entity_id").limit(20).collect()
    if clash:
        raise ValueError("ids of several classes: " + ", ".join(r["entity_id"] for r in clash))
    return out


def read_matpower(spark: SparkSession, path: str) -> DataFrame:
    """(matrix, row, cells) of the matrices of a MATPOWER case: array<double> rows, comments left out."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "%[^\n]*", "").alias("text"))
    blocks = text.select(F.explode(F.regexp_extract_all("text", F.lit(r"(mpc\.\w+\s*=\s*\[[^\]]*\])"), F.lit(1))).alias("b"))
    named = blocks.select(F.regexp_extract("b", r"mpc\.(\w+)", 1).alias("matrix"), F.regexp_extract("b", r"\[([^\]]*)\]", 1).alias("body"))
    rows = named.select("matrix", F.posexplode(F.filter(F.transform(F.split("body", "[;\n]"), lambda x: F.trim(F.regexp_replace(x, r"[\s,]+", " "))), lambda x: x != "")).alias("row", "line"))
    return rows.select("matrix", "row", F.transform(F.split("line", " "), lambda x: x.try_cast("double")).alias("cells"))


HOURLY = [str(h) for h in range(24)]


def read_hourly_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """A wide hourly table with its key columns (names and values trimmed) and its hour columns (digits)."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    hours = [c for c in rows.columns if c.isdigit()]
    keys = [c for c in rows.columns if c not in hours]
    return rows.withColumns({k: F.trim(F.col(f"`{k}`")) for k in keys}), keys, hours


def read_any(m: Model, path: str) -> Model:
    """A model by the form of its path: YAML, JSON, long CSV, a Parquet folder, or the folder of a datapackage."""
    p = Path(path.removeprefix("file://"))
    if p.is_dir():
        return read_datapackage(m, path) if (p / "datapackage.json").exists() else read_parquet_long(m, path)[0]
    from .hierarchical import read_hierarchical_yaml

    by_suffix = {".yaml": read_hierarchical_yaml, ".yml": read_hierarchical_yaml, ".json": read_json, ".csv": read_long_csv}
    if p.suffix not in by_suffix:
        raise ValueError(f"no reader for {p.suffix or 'files without a suffix'}: {path}")
    return by_suffix[p.suffix](m, path)


def import_counts(before: Model, after: Model, unknown: DataFrame | None = None) -> DataFrame:
    """entity_class, created, attributes, relations, unknowns: what a reader has added to a model, by class."""
    rows = lambda table: table.groupBy("entity_class").agg(F.count("*").alias("n"))
    out = None
    for name, a, b in (("created", before.entity, after.entity), ("attributes", before.attr, after.attr), ("relations", before.rel, after.rel)):
        part = rows(b).join(rows(a).withColumnRenamed("n", "was"), "entity_class", "left").select("entity_class", (F.col("n") - F.coalesce("was", F.lit(0))).alias(name))
        out = part if out is None else out.join(part, "entity_class", "full_outer")
    more = rows(unknown).withColumnRenamed("n", "unknowns") if unknown is not None else None
    out = out.withColumn("unknowns", F.lit(0).cast("long")) if more is None else out.join(more, "entity_class", "full_outer")
    return out.fillna(0)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
