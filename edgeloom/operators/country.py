"""Reports by country over a model: where assets stand, what they are called, and totals in long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import region_country, region_nuts3
from ..functions.text import is_set
from ..model import Model
from .navigation import DRAWS, REGION, TECHNOLOGY, asset_nodes, first_target, node_countries, reservoir_nodes
from .reports import exact_sum

GENERATION = ("GenerationUnit", "HydroGenerationUnit")
UNKNOWN = "??"


def asset_countries(m: Model, only: DataFrame | None = None) -> DataFrame:
    """entity_id and country of every entity, or of those of `only`: that of its node; a reservoir without one is where the
    first generator is that draws from it; `??` where nothing is known."""
    countries = node_countries(m, region_country(F.col("region")))
    nodes = asset_nodes(m).withColumnRenamed("node", "own").join(reservoir_nodes(m).toDF("entity_id", "fed"), "entity_id", "full_outer")
    nodes = nodes.select("entity_id", F.coalesce("own", "fed").alias("node"))
    rows = (m.entity if only is None else only).select("entity_id").join(nodes, "entity_id", "left").join(countries, "node", "left")
    return rows.select("entity_id", F.coalesce("country", F.lit(UNKNOWN)).alias("country"))


def labelled(m: Model, attributes: list[str], fallback: Column | None = None) -> DataFrame:
    """entity_id and technology: the first attribute that is set, else the technology's id, else the class."""
    cells = [F.min(F.when(F.col("attribute_id") == a, F.nullif("value_str", F.lit("")))).alias(f"a{k}") for k, a in enumerate(attributes)]
    own = m.attr.where(F.col("attribute_id").isin(*attributes)).groupBy("entity_id").agg(*cells)
    rows = m.entity.select("entity_id", "entity_class").join(own, "entity_id", "left").join(first_target(m, TECHNOLOGY, "type"), "entity_id", "left")
    last = F.col("entity_class") if fallback is None else fallback
    return rows.select("entity_id", F.coalesce(*(f"a{k}" for k in range(len(attributes))), F.nullif("type", F.lit("")), last).alias("technology"))


def assets(m: Model, attributes: dict[str, str], classes: Sequence[str]) -> DataFrame:
    """A row for each entity of the classes with country, technology and the given attributes as columns (name ->
    value_num or value_str): one grouped pass over the values. Others are left out before anything is joined."""
    cells = [F.min(F.when(F.col("attribute_id") == a, F.col(column))).alias(a) for a, column in attributes.items()]
    of_class = F.col("entity_class").isin(*classes)
    entity = m.entity.where(of_class)
    values = m.attr.where(F.col("attribute_id").isin(*attributes) & of_class).groupBy("entity_id").agg(*cells)
    rows = entity.select("entity_class", "entity_id").join(values, "entity_id", "left").join(asset_countries(m, entity), "entity_id")
    return rows.join(labelled(m.but(entity=entity), ["generator_technology_type", "storage_technology_type"]), "entity_id")


def renewable_category(label: Column) -> Column:
    """Of a label in lower case with class, id and technology; null if none fits."""
    has = lambda *words: reduce(lambda a, b: a | b, (label.contains(w) for w in words))
    kind = F.when(has("runofriver", "run_of_river", "run-of-river", ".ror", " ror"), "run_of_river").when(has("offwind", "offshore"), "wind_offshore")
    return kind.when(has("onwind", "onshore", "wind"), "wind_onshore").when(has("solar", "photovoltaic", ".pv", " pv"), "solar_pv")


def renewable_energy(m: Model) -> DataFrame:
    """country, category, total: annual energy of wind, sun and run of river, and the inflow of reservoirs."""
    rows = assets(m, {"annual_resource_potential": "value_num", "annual_natural_inflow_energy": "value_num"}, (*GENERATION, "HydraulicStorageUnit"))
    label = F.lower(F.concat_ws(" ", "entity_class", "entity_id", "technology"))
    generation = F.when(F.col("entity_class").isin(*GENERATION), F.struct(renewable_category(label).alias("category"), F.col("annual_resource_potential").alias("v")))
    inflow = F.when(F.col("entity_class") == "HydraulicStorageUnit", F.struct(F.lit("reservoir_natural_inflow").alias("category"), F.col("annual_natural_inflow_energy").alias("v")))
    cells = rows.select("country", F.coalesce(generation, inflow).alias("c")).where("c.category IS NOT NULL AND c.v IS NOT NULL")
    return cells.groupBy("country", F.col("c.category").alias("category")).agg(exact_sum(F.col("c.v")).alias("total"))


def pumped_generators(m: Model) -> DataFrame:
    """entity_id of the hydro generators that are reversible: by flag, kind or pumping power, or by the technology of a
    reservoir that they draw from."""
    of = lambda a, keep: m.attr.where((F.col("attribute_id") == a) & keep).select("entity_id")
    low = F.lower("value_str")
    own = of("is_reversible", F.coalesce("value_bool", low.isin("true", "1", "yes"))).union(of("hydro_machine_kind", low == "reversible"))
    own = own.union(of("maximum_pumping_power", F.col("value_num").isNotNull()))
    pumped = lambda c: F.lower(c).contains("phs") | F.lower(c).contains("pumped")
    stores = of("storage_technology_type", pumped(F.col("value_str"))).union(first_target(m, TECHNOLOGY, "t").where(pumped(F.col("t"))).select("entity_id"))
    drawing = m.rel.where(F.col("relation_id") == DRAWS).join(stores.toDF("target_id").distinct(), "target_id", "left_semi").select("entity_id")
    hydro = m.entity.where("entity_class = 'HydroGenerationUnit'").select("entity_id")
    return own.union(drawing).distinct().join(hydro, "entity_id", "left_semi")


MEASURES = (
    "nominal_power_capacity", "maximum_generation", "maximum_pumping_power", "annual_resource_potential", "energy_storage_capacity",
    "maximum_discharging_power", "maximum_charging_power", "annual_natural_inflow_energy", "annual_energy_demand",
)


def totals_by_country(m: Model) -> DataFrame:
    """country, category, technology, total: twelve categories, of which six are by technology (it is null in the other
    six). Each asset gives the cells of its class; one grouped pass adds them up."""
    rows = assets(m, {a: "value_num" for a in MEASURES} | {"dispatch_type": "value_str"}, (*GENERATION, "StorageUnit", "HydraulicStorageUnit", "DemandUnit"))
    rows = rows.join(pumped_generators(m).withColumn("pumped", F.lit(True)), "entity_id", "left")
    x = {a: F.coalesce(F.col(a), F.lit(0.0)) for a in MEASURES}
    either = lambda a, b: F.when(x[a] != 0, x[a]).otherwise(x[b])
    power = either("nominal_power_capacity", "maximum_generation")
    hydro, pumped = F.col("entity_class") == "HydroGenerationUnit", F.coalesce("pumped", F.lit(False))
    plain = F.col("entity_class") == "GenerationUnit"
    kind = F.lower(F.coalesce("dispatch_type", F.lit("")))
    store, reservoir, demand = (F.col("entity_class") == c for c in ("StorageUnit", "HydraulicStorageUnit", "DemandUnit"))
    potential = x["annual_resource_potential"]
    cell = lambda category, by, keep, v: F.when(keep, F.struct(F.lit(category).alias("category"), (F.col("technology") if by else F.lit(None).cast("string")).alias("technology"), v.alias("v")))
    cells = F.array(
        cell("dispatchable_capacity_mw", True, plain & (kind != "nondispatchable"), power),
        cell("nondispatchable_capacity_mw", True, plain & (kind == "nondispatchable"), power),
        cell("nondispatchable_annual_resource_potential_mwh", True, ((plain & (kind == "nondispatchable")) | (hydro & (kind != "dispatchable"))) & (potential != 0), potential),
        cell("hydro_turbine_discharge_capacity_mw", False, hydro & ~pumped, power),
        cell("hydro_reversible_discharge_capacity_mw", False, hydro & pumped, power),
        cell("hydro_reversible_charge_capacity_mw", False, hydro & pumped, x["maximum_pumping_power"]),
        cell("storage_energy_capacity_mwh", True, store, x["energy_storage_capacity"]),
        cell("storage_discharge_capacity_mw", True, store, either("nominal_power_capacity", "maximum_discharging_power")),
        cell("storage_charge_capacity_mw", True, store, x["maximum_charging_power"]),
        cell("reservoir_capacity_mwh", False, reservoir, x["energy_storage_capacity"]),
        cell("reservoir_inflow_mwh", False, reservoir, x["annual_natural_inflow_energy"]),
        cell("demand_annual_energy_mwh", False, demand, x["annual_energy_demand"]),
    )
    out = rows.select("country", F.explode(cells).alias("c")).where("c IS NOT NULL").select("country", "c.*")
    return out.groupBy("country", "category", "technology").agg(exact_sum(F.col("v")).alias("total"))


def bus_codes(m: Model, bus_class: str = "ElectricalBus") -> DataFrame:
    """bus and code, in lower case: of the first region of level nuts3 that the bus belongs to, else the second part of
    an id `node.<code>.<kv>`; buses without either are left out."""
    regions = m.rel.where((F.col("relation_id") == REGION) & region_nuts3(F.col("target_id")).isNotNull())
    first = regions.groupBy("entity_id").agg(F.min_by(region_nuts3(F.col("target_id")), "ord").alias("code"))
    own = F.when(F.col("entity_id").rlike(r"^node\.[^.]*\."), F.lower(F.split_part("entity_id", F.lit("."), F.lit(2))))
    rows = m.entity.where(F.col("entity_class") == bus_class).select("entity_id").join(first, "entity_id", "left")
    return rows.select(F.col("entity_id").alias("bus"), F.coalesce("code", own).alias("code")).where(is_set(F.col("code")))


def distinct_codes(codes: DataFrame) -> DataFrame:
    return codes.select("code").distinct().orderBy("code")


def checked_selectors(codes: DataFrame, selectors: list[str]) -> DataFrame:
    """selector and whether any code has it: two letters compare countries, more are a prefix."""
    wanted = codes.sparkSession.createDataFrame([(s.lower().split(".", 1)[-1],) for s in selectors], "selector string")
    fits = F.col("code").startswith(F.col("selector"))
    return wanted.join(codes.select("code").distinct(), fits, "left").groupBy("selector").agg(F.bool_or(F.col("code").isNotNull()).alias("valid"))


def buses_by_country(codes: DataFrame) -> DataFrame:
    return codes.groupBy(F.upper(F.left("code", F.lit(2))).alias("country")).agg(F.count("*").alias("n"))


def profile_references(m: Model) -> DataFrame:
    """profile_id and its data_reference, null where there is none."""
    found = m.attr.where("attribute_id = 'data_reference'").select(F.col("entity_id").alias("profile_id"), F.col("value_str").alias("data_reference"))
    return m.entity.where("entity_class = 'Profile'").select(F.col("entity_id").alias("profile_id")).join(found, "profile_id", "left")


def technology_ids(m: Model) -> DataFrame:
    """entity_id and technology: hasTechnology, else instanceOfType, else the class."""
    rows = m.entity.select("entity_id", "entity_class").join(first_target(m, TECHNOLOGY, "t"), "entity_id", "left").join(first_target(m, "instanceOfType", "i"), "entity_id", "left")
    return rows.select("entity_id", F.coalesce(F.nullif("t", F.lit("")), F.nullif("i", F.lit("")), "entity_class").alias("technology"))
