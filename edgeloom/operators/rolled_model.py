"""A whole model rolled up: every asset goes one of two ways in the same pass.

An asset at a bus of level `disaggregated` is passed through as it is, with its values, relations and series, unless its
technology matches a pattern of `groups`; all others are merged by node, bucket and technology tag. Hydro generators and
reservoirs of pumped storage never merge with others: their tags end in `.phs` or `.nonphs`. Branches are never merged.

`plan` says for each asset where it goes; what follows are grouped aggregates and joins over it. Nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import id_tag, is_set, longest_pattern, technology_matches
from ..lineage import cut
from ..model import Model, attribute_rows
from . import rollup
from .country import bus_codes, pumped_generators
from .navigation import DRAWS, NODE, PROFILES, REGION, TECHNOLOGY, reservoir_nodes
from .profiles import combined, normalised
from .reports import dominant, exact_sum, weighted_average
from .subset import BRANCHES

HYDRO, RESERVOIR, STORE, DEMAND = "HydroGenerationUnit", "HydraulicStorageUnit", "StorageUnit", "DemandUnit"
PLAIN = ("GenerationUnit", "WindGenerationUnit", "SolarGenerationUnit", "ThermalGenerationUnit")
#: Values that are merged: summed, or averaged by another one.
SUMS = ("nominal_power_capacity", "annual_resource_potential", "maximum_pumping_power", "energy_storage_capacity", "maximum_charging_power", "annual_natural_inflow_energy", "annual_energy_demand")
AVERAGES = {"energy_conversion_efficiency": "nominal_power_capacity", "variable_operating_cost": "nominal_power_capacity", "turbine_efficiency": "nominal_power_capacity", "charging_efficiency": "maximum_charging_power", "discharging_efficiency": "nominal_power_capacity", "charging_variable_operating_cost": "maximum_charging_power"}
KINDS = ("dispatch_type", "hydro_machine_kind")
#: Values of a merged asset by class; sums in ALWAYS are there even if 0.
KEPT = {
    "GenerationUnit": ("nominal_power_capacity", "annual_resource_potential", "energy_conversion_efficiency", "variable_operating_cost", "dispatch_type", "generator_technology_type"),
    HYDRO: ("nominal_power_capacity", "annual_resource_potential", "maximum_pumping_power", "pumping_efficiency", "turbine_efficiency", "variable_operating_cost", "dispatch_type", "hydro_machine_kind"),
    STORE: ("energy_storage_capacity", "nominal_power_capacity", "maximum_charging_power", "charging_efficiency", "discharging_efficiency", "variable_operating_cost", "charging_variable_operating_cost", "storage_technology_type"),
    RESERVOIR: ("energy_storage_capacity", "annual_natural_inflow_energy"),
    DEMAND: ("annual_energy_demand",),
}
ALWAYS = {"GenerationUnit": "nominal_power_capacity", HYDRO: "nominal_power_capacity", STORE: "energy_storage_capacity", RESERVOIR: "energy_storage_capacity", DEMAND: "annual_energy_demand"}


def model_buses(m: Model, bus_class: str = "ElectricalBus") -> DataFrame:
    """bus, nuts3, kv, lat, lon of the buses with a region code, as bus_map takes them."""
    cell = lambda a, name: F.min(F.when(F.col("attribute_id") == a, F.col("value_num"))).alias(name)
    places = m.attr.where(F.col("attribute_id").isin("nominal_voltage", "latitude", "longitude")).groupBy(F.col("entity_id").alias("bus"))
    places = places.agg(cell("nominal_voltage", "kv"), cell("latitude", "lat"), cell("longitude", "lon"))
    return bus_codes(m, bus_class).withColumnRenamed("code", "nuts3").join(places, "bus", "left")


def _region_key() -> Column:
    """What the id of a merged asset ends in; at a bus that stays, the bus's own id, so that buses of a region differ."""
    own = F.when(F.col("agg").startswith("node."), F.substring("agg", 6, 1 << 30)).otherwise(id_tag(F.col("agg")))
    return F.when(F.col("level") == "disaggregated", own).otherwise(F.concat("rc", "suffix"))


def plan(m: Model, mapped: DataFrame, groups: Mapping[str, list[str]] | None = None) -> DataFrame:
    """For each asset at a bus of `mapped` (see rollup.bus_map): out_class, out_id, whether it is copied, agg (its node),
    key, tag, profile, reservoir, and its values: one grouped pass over the values and one over the relations."""
    groups = dict(groups or {})
    numbers = [*SUMS, *AVERAGES, "pumping_efficiency"]
    texts = [*KINDS, "generator_technology_type", "storage_technology_type"]
    cells = [F.min(F.when(F.col("attribute_id") == a, F.col(c))).alias(a) for names, c in ((numbers, "value_num"), (texts, "value_str")) for a in names]
    values = m.attr.where(F.col("attribute_id").isin(*numbers, *texts)).groupBy("entity_id").agg(*cells)
    first = lambda r, name: F.min_by("target_id", F.when((F.col("relation_id") == r) & is_set(F.col("target_id")), F.col("ord"))).alias(name)
    order = F.array_position(F.array(*map(F.lit, PROFILES)), F.col("relation_id"))
    profile = F.min_by("target_id", F.when(F.col("relation_id").isin(*PROFILES), F.struct(order, F.col("ord")))).alias("profile")
    named = {NODE: "node", TECHNOLOGY: "technology", "instanceOfType": "type", DRAWS: "reservoir"}
    hops = m.rel.where(F.col("relation_id").isin(*named, *PROFILES)).groupBy("entity_id").agg(*(first(r, n) for r, n in named.items()), profile)
    classes = (*PLAIN, HYDRO, RESERVOIR, STORE, DEMAND)
    rows = m.entity.where(F.col("entity_class").isin(*classes)).select("entity_class", "entity_id", "seq")
    rows = rows.join(values, "entity_id", "left").join(hops, "entity_id", "left").join(reservoir_nodes(m).toDF("entity_id", "fed"), "entity_id", "left")
    pumped = pumped_generators(m)
    drawn = m.rel.where(F.col("relation_id") == DRAWS).groupBy("entity_id").agg(F.min_by("target_id", "ord").alias("r")).join(pumped, "entity_id", "left_semi").select(F.col("r").alias("entity_id"))
    rows = rows.join(pumped.union(drawn).distinct().withColumn("pumped", F.lit(True)), "entity_id", "left")
    places = mapped.select(F.col("bus").alias("at"), "agg", "level", "rc", "suffix")
    rows = rows.withColumn("at", F.coalesce("node", F.when(F.col("entity_class") == RESERVOIR, F.col("fed")))).join(places, "at").withColumn("key", _region_key())
    water = F.col("entity_class").isin(HYDRO, RESERVOIR)
    own = F.when(F.col("entity_class").isin(RESERVOIR, STORE), F.col("storage_technology_type")).otherwise(F.col("generator_technology_type"))
    tech = F.coalesce(F.nullif(own, F.lit("")), "technology", "type", "entity_class")
    tag = id_tag(longest_pattern(tech, groups))
    tag = F.when(water, F.concat(tag, F.when(F.coalesce("pumped", F.lit(False)), ".phs").otherwise(".nonphs"))).otherwise(tag)
    matches = reduce(lambda a, b: a | b, (technology_matches(tech, p) for ps in groups.values() for p in ps), F.lit(False))
    is_demand = F.col("entity_class") == DEMAND
    rows = rows.withColumn("tag", tag).withColumn("copied", (F.col("level") == "disaggregated") & (is_demand | ~matches))
    merged = F.when(is_demand, F.concat(F.lit("demand.agg."), "key")).otherwise(F.concat(F.when(F.col("entity_class").isin(RESERVOIR, STORE), "storage.").otherwise("gen."), "tag", F.lit(".agg."), "key"))
    rows = rows.withColumn("out_id", F.when(F.col("copied"), F.col("entity_id")).otherwise(merged))
    return rows.withColumn("out_class", F.when(F.col("entity_class").isin(*PLAIN), "GenerationUnit").otherwise(F.col("entity_class")))


def merged_assets(rows: DataFrame) -> DataFrame:
    """A row for each merged asset of a plan: out_class, out_id, agg, key, tag, seq, its merged values, n."""
    keys = ["out_class", "out_id", "agg", "key", "tag"]
    averages = [weighted_average(F.col(a), F.col(w)).alias(a) for a, w in AVERAGES.items()]
    pump = F.coalesce(weighted_average(F.col("pumping_efficiency"), F.col("maximum_pumping_power")), weighted_average(F.col("pumping_efficiency"), F.col("nominal_power_capacity")))
    part = rows.where("NOT copied")
    out = part.groupBy(*keys).agg(*(exact_sum(F.col(a)).alias(a) for a in SUMS), *averages, pump.alias("pumping_efficiency"), F.min("seq").alias("seq"), F.count("*").alias("n"))
    for kind in KINDS:
        out = out.join(dominant(part.where(is_set(F.col(kind))), ["out_id"], kind, "seq").drop("n"), "out_id", "left")
    return out.withColumns({"generator_technology_type": F.col("tag"), "storage_technology_type": F.col("tag")})


def _rows(df: DataFrame, class_: Column, entity: Column, relation: str | Column, target: Column, place: Column | None = None) -> DataFrame:
    out = df.select(class_.alias("entity_class"), entity.alias("entity_id"), (F.lit(relation) if isinstance(relation, str) else relation).alias("relation_id"), target.alias("target_id"), (F.lit(0) if place is None else place).cast("int").alias("ord"))
    return out.where("target_id IS NOT NULL")


def merged_series(m: Model, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The series of merged assets (profile_id, t, value), and (out_class, out_id, relation_id, profile_id) of those that
    have one."""
    part = rows.where("NOT copied AND profile IS NOT NULL")
    gen, store, demand = (part.where(F.col("out_class").isin(*c)) for c in (("GenerationUnit", HYDRO), (RESERVOIR,), (DEMAND,)))
    series = m.profile_value
    name = lambda kind: F.concat(F.lit(f"profile.{kind}."), *([] if kind == "demand" else [F.col("tag"), F.lit(".")]), F.col("key"))
    of_gen = rollup.rolled_profiles(series, gen.select(name("gen").alias("group_id"), F.col("profile").alias("profile_id"), F.col("annual_resource_potential").alias("potential"), F.col("nominal_power_capacity").alias("capacity"))).drop("kind")
    of_demand = rollup.rolled_demand_profiles(series, demand.select(name("demand").alias("group_id"), F.col("profile").alias("profile_id"), F.col("annual_energy_demand").alias("annual")))
    of_inflow = normalised(combined(series, store.select(name("inflow").alias("group_id"), F.col("profile").alias("profile_id"), F.col("annual_natural_inflow_energy").alias("weight")), divide=False))
    columns = ["profile_id", "t", "value"]
    out = of_gen.select(*columns).union(of_demand.select(*columns)).union(of_inflow.select(*columns))
    relation = lambda r, kind, t: t.select("out_class", "out_id", (F.lit(r) if isinstance(r, str) else r).alias("relation_id"), name(kind).alias("profile_id"))
    owners = relation(F.when(F.col("out_class") == HYDRO, PROFILES[2]).otherwise(PROFILES[0]), "gen", gen).union(relation(PROFILES[1], "demand", demand)).union(relation(PROFILES[2], "inflow", store)).distinct()
    return out, owners.join(out.select("profile_id").distinct(), "profile_id", "left_semi").select("out_class", "out_id", "relation_id", "profile_id")


def rolled_model(m: Model, mapped: DataFrame, groups: Mapping[str, list[str]] | None = None) -> Model:
    """The model on the nodes of `mapped`: merged and copied assets, remapped branches, nodes with their regions, and the
    series of both."""
    mapped, rows = cut(mapped), cut(plan(m, mapped, groups))
    merged = cut(merged_assets(rows))
    copies = rows.where("copied").select("entity_id", "out_class", "agg")
    # assets
    entity = rows.groupBy(F.col("out_class").alias("entity_class"), F.col("out_id").alias("entity_id")).agg(F.min("seq").alias("seq"))
    wide = merged.withColumns({a: F.when((F.col(a) > 0) | (F.create_map(*(F.lit(x) for p in ALWAYS.items() for x in p))[F.col("out_class")] == a), F.col(a)) for a in SUMS})
    attr = [attribute_rows(wide.where(F.col("out_class") == c).withColumn("name", F.col("out_id")), c, F.col("out_id"), {a: a for a in ("name", *names)}) for c, names in KEPT.items()]
    attr.append(m.attr.join(copies.select("entity_id", "out_class"), "entity_id").withColumn("entity_class", F.col("out_class")).select(*m.attr.columns))
    rel = [_rows(merged.where(F.col("out_class") != RESERVOIR), F.col("out_class"), F.col("out_id"), NODE, F.col("agg"))]
    rel.append(m.rel.join(copies.select("entity_id", "out_class"), "entity_id").withColumn("entity_class", F.col("out_class")).select(*m.rel.columns))
    stores = rows.where(F.col("entity_class") == RESERVOIR).select(F.col("entity_id").alias("reservoir"), F.col("out_id").alias("store"))
    draws = rows.where("NOT copied").join(stores, "reservoir").groupBy("out_class", "out_id", "store").agg(F.min("seq").alias("seq"))
    rel.append(_rows(draws, F.col("out_class"), F.col("out_id"), DRAWS, F.col("store"), F.col("seq")))
    # branches
    ends = lambda r, c: m.rel.where(F.col("relation_id") == r).groupBy("entity_id").agg(F.min_by("target_id", "ord").alias(c))
    switch = lambda a, c: m.attr.where(F.col("attribute_id") == a).groupBy("entity_id").agg(F.min("value_num").alias(c))
    branches = m.entity.where(F.col("entity_class").isin(*BRANCHES)).join(ends("fromNode", "from_bus"), "entity_id").join(ends("toNode", "to_bus"), "entity_id")
    branches = branches.join(switch("from_switch_closed", "from_on"), "entity_id", "left").join(switch("to_switch_closed", "to_on"), "entity_id", "left")
    branches = cut(rollup.remapped_branches(branches, mapped).where("dropped IS NULL").select("entity_class", "entity_id", "seq", "from_node", "to_node"))
    attr.append(m.attr.join(branches.select("entity_id"), "entity_id", "left_semi").select(*m.attr.columns))
    rel += [_rows(branches, F.col("entity_class"), F.col("entity_id"), r, F.col(c)) for r, c in (("fromNode", "from_node"), ("toNode", "to_node"))]
    rel.append(m.rel.where(~F.col("relation_id").isin("fromNode", "toNode")).join(branches.select("entity_id"), "entity_id", "left_semi").select(*m.rel.columns))
    # nodes: those that stay are copied with their regions, the others are made
    nodes = cut(rollup.rolled_buses(mapped.where("level <> 'disaggregated'")))
    bus = F.lit("ElectricalBus")
    made = nodes.select("agg", F.col("agg").alias("name"), F.col("kv").cast("double").alias("nominal_voltage"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    attr.append(attribute_rows(made, "ElectricalBus", F.col("agg"), {a: a for a in ("name", "nominal_voltage", "latitude", "longitude")}))
    region = F.concat(F.lit("region."), "region")
    rel.append(_rows(nodes, bus, F.col("agg"), REGION, region))
    whole = m.entity.join(mapped.where("level = 'disaggregated'").select(F.col("bus").alias("entity_id")), "entity_id", "left_semi")
    near = m.rel.where(F.col("relation_id") == REGION).join(whole.select("entity_id"), "entity_id", "left_semi").select(F.col("target_id").alias("entity_id"))
    # series
    series, owners = merged_series(m, rows)
    series, owners = cut(series), cut(owners)
    rel.append(_rows(owners, F.col("out_class"), F.col("out_id"), F.col("relation_id"), F.col("profile_id")))
    held = rows.where("copied AND profile IS NOT NULL").select(F.col("profile").alias("entity_id")).union(near)
    kept = m.entity.join(held.distinct(), "entity_id", "left_semi").select(*m.entity.columns).union(whole.select(*m.entity.columns))
    for t, parts in ((m.attr, attr), (m.rel, rel)):
        parts.append(t.join(kept.select("entity_id"), "entity_id", "left_semi").select(*t.columns))
    old = m.profile_value.join(kept.select(F.col("entity_id").alias("profile_id")), "profile_id", "left_semi").select(*m.profile_value.columns)
    of = lambda t, class_, c: t.select(class_.alias("entity_class"), F.col(c).alias("entity_id")).distinct()
    made_ids = of(nodes, bus, "agg").union(of(nodes.withColumn("region", region), F.lit("GeographicalRegion"), "region")).union(of(series, F.lit("Profile"), "profile_id"))
    listed = entity.select("entity_class", "entity_id", "seq").union(branches.select("entity_class", "entity_id", "seq")).union(made_ids.withColumn("seq", F.lit(0).cast("long")))
    entity = listed.select("entity_class", "entity_id", F.lit(False).alias("is_library"), "seq").unionByName(kept)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return m.but(entity=entity, attr=union(attr), rel=union(rel), profile_value=series.unionByName(old))
