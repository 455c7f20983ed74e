"""Steps of the hourly market pipelines and of the grid converters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Model


def carry_forward(rows: DataFrame, keys: list[str], year: str, wanted: int) -> DataFrame:
    """Of each group (null keys together) the rows of the latest year up to the wanted one, else of the earliest; a
    group without any year goes."""
    group = Window.partitionBy(*keys)
    upto = F.max(F.when(F.col(year) <= wanted, F.col(year))).over(group)
    return rows.withColumn("__year", F.coalesce(upto, F.min(year).over(group))).where(F.col(year) == F.col("__year")).drop("__year")


def with_increments(base: DataFrame, increments: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Base values plus the increment of the same keys, if there is one."""
    more = increments.groupBy(*keys).agg(F.sum(value).alias("__more"))
    return base.join(more, keys, "left").withColumn(value, F.col(value) + F.coalesce("__more", F.lit(0))).drop("__more")


def summed_union(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def numbered(rows: DataFrame, keys: list[str], seq: str, stem: Column) -> DataFrame:
    """Ids from a stem and a counter of two digits at least that runs within the keys in load order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(seq))
    return rows.withColumn("new_id", F.format_string("%s.%02d", stem, n))


def pruned(m: Model, gone: DataFrame) -> Model:
    """Without the entities in `gone` (entity_id), their values, and relations to or from them."""
    ids, ends = gone.select("entity_id").distinct(), gone.select(F.col("entity_id").alias("target_id")).distinct()
    rel = m.rel.join(ids, "entity_id", "left_anti").join(ends, "target_id", "left_anti").select(*m.rel.columns)
    return m.but(entity=m.entity.join(ids, "entity_id", "left_anti").select(*m.entity.columns), attr=m.attr.join(ids, "entity_id", "left_anti").select(*m.attr.columns), rel=rel)


def without_inflow(m: Model, pumped: DataFrame) -> DataFrame:
    """Reservoirs that have neither inflow nor pumped storage (`pumped`: entity_id)."""
    reservoirs = m.entity.where("entity_class = 'HydraulicStorageUnit'").select("entity_id")
    fed = m.attr.where("attribute_id = 'annual_natural_inflow_energy' and value_num > 0").select("entity_id")
    linked = m.rel.where("relation_id = 'hasNaturalInflowProfile'").select("entity_id")
    return reservoirs.join(fed, "entity_id", "left_anti").join(linked, "entity_id", "left_anti").join(pumped, "entity_id", "left_anti")


def bus_voltages(buses: DataFrame, lines: DataFrame) -> DataFrame:
    """Buses (bus, kv) of at most 1 kV take the voltage of the first of their lines (from_bus, to_bus, kv, seq)."""
    ends = lines.select(F.col("from_bus").alias("bus"), "kv", "seq").union(lines.select("to_bus", "kv", "seq"))
    seen = ends.groupBy("bus").agg(F.min_by("kv", "seq").alias("line_kv"))
    return buses.join(seen, "bus", "left").select("bus", F.when(F.col("kv") > 1, F.col("kv")).otherwise(F.coalesce("line_kv", "kv")).alias("kv"))


def is_transformer(tap: Column) -> Column:
    return F.coalesce((tap != 0) & (tap != 1), F.lit(False))


def links_split(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links whose ends carry the same become direct-current links, the others conversion units with a row for each
    port (bus0 to bus3)."""
    same = F.col("carrier0") == F.col("carrier1")
    ports = F.explode(F.array(*(F.struct(F.lit(k).alias("port"), F.col(f"bus{k}").alias("bus")) for k in range(4))))
    units = links.where(~same).select("link", ports.alias("p")).select("link", "p.port", "p.bus").where("bus is not null and bus <> ''")
    return links.where(same), units


def assigned_numbers(rows: DataFrame, entity: str, explicit: Column) -> DataFrame:
    """Numbers for matrix rows: the explicit one, else the digits that end the id, else the next free one. A number
    that is taken moves to one above all others. The repair is sequential, so each `part` of the table (a grid, which
    is small) is one group."""
    wanted = F.coalesce(explicit.cast("long"), F.nullif(F.regexp_extract(F.col(entity), r"(\d+)$", 1), F.lit("")).try_cast("long"))

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part, taken, numbers = part.sort_values("id", ignore_index=True), set(), []
        top = int(part["wanted"].max()) if part["wanted"].notna().any() else 0
        for w in part["wanted"]:
            if pd.isna(w) or int(w) <= 0 or int(w) in taken:
                top += 1
                w = top
            taken.add(int(w))
            top = max(top, int(w))
            numbers.append(int(w))
        return part.assign(number=numbers)[["part", "id", "number"]]

    return rows.select("part", F.col(entity).alias("id"), wanted.alias("wanted")).groupBy("part").applyInPandas(assign, "part string, id string, number long")
