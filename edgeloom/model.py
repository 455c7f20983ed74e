"""The long tables that every operator reads: entities, attributes, relations, profiles, and the compiled schema."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTITY = "entity_class string, entity_id string, is_library boolean, seq long"
ATTRIBUTE = "entity_class string, entity_id string, attribute_id string, value_str string, value_num double, value_bool boolean, unit string, provenance_ref string"
RELATION = "entity_class string, entity_id string, relation_id string, target_id string, ord int"
PROFILE = "profile_id string, t int, value double"
CLASS = "class_name string, parents array<string>, abstract boolean, view_family string, role string, top_family string"
CLOSURE = "class_name string, ancestor string, depth int"
FIELD = (
    "class_name string, kind string, field_id string, dtype string, required boolean, default string, minimum double, maximum double, "
    "enum array<string>, pattern string, units array<string>, targets array<string>, cardinality string, groups array<string>, ord int"
)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that lives in the plan: the optimiser sees its rows, and no Python worker has to make them."""
    names = [f.name for f in StructType.fromDDL(schema)]
    if not rows:
        return spark.createDataFrame([], schema)
    columns = [pa.array([r[k] for r in rows]) for k in range(len(names))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names)).to(StructType.fromDDL(schema))


@dataclass(frozen=True)
class Model:
    """`seq` and `ord` carry the load order, on which first- and last-wins rules rest: rows have none of their own."""

    entity: DataFrame
    attr: DataFrame
    rel: DataFrame
    profile_value: DataFrame
    class_def: DataFrame
    class_closure: DataFrame
    field_def: DataFrame

    def but(self, **tables: DataFrame) -> Model:
        return replace(self, **tables)

    @property
    def spark(self) -> SparkSession:
        return self.entity.sparkSession

    def register(self, prefix: str = "") -> None:
        """Temporary views of all tables, for Spark SQL."""
        for name in self.__dataclass_fields__:
            getattr(self, name).createOrReplaceTempView(prefix + name)


def attribute_rows(df: DataFrame, entity_class: str, entity_id, values: dict[str, str], units: dict[str, str] | None = None) -> DataFrame:
    """ATTRIBUTE rows of a wide table: one row for each column in `values` (attribute -> column) that is not null."""
    kinds = dict(df.dtypes)
    rows = []
    for attribute, column in values.items():
        c, kind = F.col(column), kinds[column]
        number = c.cast("double") if kind in ("double", "float", "int", "bigint") or kind.startswith("decimal") else F.lit(None).cast("double")
        flag = c if kind == "boolean" else F.lit(None).cast("boolean")
        unit = F.lit((units or {}).get(attribute)).cast("string")
        rows.append(F.struct(F.lit(attribute).alias("attribute_id"), c.cast("string").alias("value_str"), number.alias("value_num"), flag.alias("value_bool"), unit.alias("unit")))
    out = df.select(F.lit(entity_class).alias("entity_class"), entity_id.alias("entity_id"), F.explode(F.array(*rows)).alias("a"))
    return out.select("entity_class", "entity_id", "a.*", F.lit(None).cast("string").alias("provenance_ref")).where("value_str is not null")


def relation_rows(df: DataFrame, entity_class: str, entity_id, relation: str, target) -> DataFrame:
    """RELATION rows of a foreign key."""
    out = df.select(F.lit(entity_class).alias("entity_class"), entity_id.alias("entity_id"), F.lit(relation).alias("relation_id"), target.alias("target_id"), F.lit(0).alias("ord"))
    return out.where("target_id is not null")
