"""Spatial roll-up: buses of a region become one node, and what stands at them is merged so that totals are kept.

One table maps buses, one maps members; each rule is a grouped aggregate over them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded_kv
from ..functions.text import id_tag, longest_pattern, nuts_level
from .profiles import combined, normalised
from .reports import exact_sum, weighted_average


def bus_map(buses: DataFrame, level: str = "country", overrides: Mapping[str, str] | None = None, split_voltage: bool = True, digits: int = 0) -> DataFrame:
    """bus, agg, country, level, rc, kv of `buses` (bus, nuts3, kv, lat, lon). Without a region code a bus is left out;
    `disaggregated` keeps each one as it is. `overrides` gives the level of single countries."""
    rows = buses.where("nuts3 is not null and nuts3 <> ''").withColumn("country", F.upper(F.left("nuts3", F.lit(2))))
    levels = F.create_map(*(F.lit(x) for pair in (overrides or {"": level}).items() for x in pair))
    rows = rows.withColumn("level", F.coalesce(levels[F.col("country")], F.lit(level)))
    code = F.lower("nuts3")
    cut = lambda name: nuts_level(code, name)
    rc = F.when(F.col("level") == "country", cut("country")).when(F.col("level") == "nuts1", cut("nuts1")).when(F.col("level") == "nuts2", cut("nuts2")).otherwise(code)
    kv = rounded_kv(F.col("kv"), digits)
    suffix = F.coalesce(F.concat(F.lit("."), kv.cast("string")), F.lit("")) if split_voltage else F.lit("")
    agg = F.when(F.col("level") == "disaggregated", F.col("bus")).otherwise(F.concat(F.lit("node."), rc, suffix))
    return rows.select("bus", agg.alias("agg"), "country", "level", rc.alias("rc"), suffix.alias("suffix"), kv.alias("kv"), "lat", "lon")


def rolled_buses(mapped: DataFrame) -> DataFrame:
    """agg, country, region, kv, lat and lon (means of those known), n."""
    region = F.concat(F.when(F.col("level") == "disaggregated", F.lit("nuts3")).otherwise(F.col("level")), F.lit("."), F.col("rc"))
    rows = mapped.groupBy("agg", "country", region.alias("region"))
    return rows.agg(F.max("kv").alias("kv"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def member(rows: DataFrame, mapped: DataFrame, technology: Column, groups: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Rows of assets (with `bus`) with the node they go to and the tag of their technology group."""
    tag = id_tag(longest_pattern(technology, dict(groups or {})))
    return rows.withColumn("tag", tag).join(mapped.select("bus", "agg", "country", "rc", "suffix"), "bus")


def rolled_demand(members: DataFrame) -> DataFrame:
    named = F.concat(F.lit("demand.agg."), F.col("rc"), F.col("suffix"))
    return members.groupBy(named.alias("id"), "agg", "country").agg(exact_sum(F.col("annual")).alias("annual"), F.count("*").alias("n"))


def rolled_generation(members: DataFrame) -> DataFrame:
    """By node, bucket (hydro or not) and tag: sums of capacity and potential, averages by capacity, pumping efficiency
    by pumping power where there is any, and the most frequent kind is left to `dominant`."""
    named = F.concat(F.lit("gen."), F.col("tag"), F.lit(".agg."), F.col("rc"), F.col("suffix"))
    pump = F.coalesce(weighted_average(F.col("pumping_efficiency"), F.col("pumping")), weighted_average(F.col("pumping_efficiency"), F.col("capacity")))
    return members.groupBy(named.alias("id"), "agg", "country", "bucket", "tag").agg(
        exact_sum(F.col("capacity")).alias("capacity"),
        F.nullif(exact_sum(F.col("potential")), F.lit(0.0)).alias("potential"),
        exact_sum(F.col("pumping")).alias("pumping"),
        weighted_average(F.col("efficiency"), F.col("capacity")).alias("efficiency"),
        weighted_average(F.col("variable_cost"), F.col("capacity")).alias("variable_cost"),
        pump.alias("pumping_efficiency"),
        F.count("*").alias("n"),
    )


def rolled_storage(members: DataFrame) -> DataFrame:
    named = F.concat(F.lit("storage."), F.col("tag"), F.lit(".agg."), F.col("rc"), F.col("suffix"))
    return members.groupBy(named.alias("id"), "entity_class", "agg", "country", "tag").agg(
        exact_sum(F.col("energy")).alias("energy"),
        exact_sum(F.col("power")).alias("power"),
        F.nullif(exact_sum(F.col("charging")), F.lit(0.0)).alias("charging"),
        F.nullif(exact_sum(F.col("inflow")), F.lit(0.0)).alias("inflow"),
        weighted_average(F.col("charging_efficiency"), F.col("charging")).alias("charging_efficiency"),
        weighted_average(F.col("discharging_efficiency"), F.col("power")).alias("discharging_efficiency"),
        F.count("*").alias("n"),
    )


def rolled_profiles(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """The series of each group of `members` (group_id, profile_id, potential, capacity): weighed by potential and
    normalised to 1 where the group has any, else weighed by capacity and divided by it. `kind` says which."""
    whole = members.groupBy("group_id").agg(F.sum("potential").alias("all"))
    rows = members.join(whole, "group_id")
    by = lambda name, keep: rows.where(keep).select("group_id", "profile_id", F.col(name).alias("weight"))
    energy = normalised(combined(profiles, by("potential", F.col("all") > 0), divide=False)).withColumn("kind", F.lit("as_normalized_annual_energy"))
    factor = combined(profiles, by("capacity", F.coalesce(F.col("all") <= 0, F.lit(True)))).withColumn("kind", F.lit("as_capacity_factor"))
    return energy.unionByName(factor)


def rolled_demand_profiles(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """Weighed by annual demand and normalised by the size of the sum, so that withdrawals sum to -1."""
    rows = members.select("group_id", "profile_id", F.col("annual").alias("weight"))
    return normalised(combined(profiles, rows, divide=False), negative=True)


def remapped_branches(branches: DataFrame, mapped: DataFrame) -> DataFrame:
    """Branches (id, from_bus, to_bus, from_on, to_on) with the nodes of their ends and the reason why one goes
    (`outside`, `switched_off`, `internal`; null: it stays). Branches are never merged."""
    ends = mapped.select("bus", "agg")
    rows = branches.join(ends.toDF("from_bus", "from_node"), "from_bus", "left").join(ends.toDF("to_bus", "to_node"), "to_bus", "left")
    off = F.coalesce((F.col("from_on") == 0) | (F.col("to_on") == 0), F.lit(False))
    outside = F.col("from_node").isNull() | F.col("to_node").isNull()
    return rows.withColumn("dropped", F.when(outside, "outside").when(off, "switched_off").when(F.col("from_node") == F.col("to_node"), "internal"))


def storage_links(draws: DataFrame, generator_groups: DataFrame, storage_groups: DataFrame) -> DataFrame:
    """Distinct (generator group, storage group) of single links (entity_id, reservoir)."""
    return draws.join(generator_groups, "entity_id").join(storage_groups, "reservoir").select("generator_group", "storage_group").distinct()


def orphan_groups(storage_groups: DataFrame, links: DataFrame) -> DataFrame:
    """Storage groups without a link, with the reservoirs that they were made of."""
    free = storage_groups.select("storage_group").distinct().join(links, "storage_group", "left_anti")
    return storage_groups.join(free, "storage_group", "left_semi")
