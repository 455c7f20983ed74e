"""A model over star-schema tables: regions, nations as nodes, suppliers as generators, customers as demand, parts as
technologies."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PROFILE, Model, attribute_rows, relation_rows
from ..plans.schema import Schema
from .layout import once

SCHEMA = {
    "units": {"MW": {}, "MWh": {}},
    "attributes": {
        "nominal_power_capacity": {"type": "decimal", "constraints": {"minimum": 0}, "unit": "MW"},
        "annual_energy_demand": {"type": "decimal", "constraints": {"minimum": 0}, "unit": "MWh"},
        "segment": {"type": "string", "constraints": {"enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]}},
        "brand": {"type": "string", "constraints": {"pattern": "Brand#[0-9]"}},
        "size": {"type": "integer", "constraints": {"maximum": 45}},
        "label": {"type": "integer"},
        "name": {"type": "string"},
        "price": {"type": "decimal"},
    },
    "relations": {
        "atNode": {"target": "NetworkNode"},
        "belongsToGeographicalRegion": {"target": "GeographicalRegion"},
        "hasTechnology": {"target": "GeneratorType"},
    },
    "classes": {
        "SemanticEntity": {"abstract": True},
        "EnergyAssetInstance": {"parents": ["SemanticEntity"], "abstract": True, "attributes": ["name"]},
        "GenerationUnit": {
            "parents": ["EnergyAssetInstance"],
            "attributes": ["nominal_power_capacity"],
            "relations": [{"id": "atNode", "required": True}, {"id": "hasTechnology", "required": True}],
        },
        "DemandUnit": {
            "parents": ["EnergyAssetInstance"],
            "attributes": ["annual_energy_demand", "segment", {"id": "price", "required": True, "belongsToGroup": ["market"]}, {"id": "label", "belongsToGroup": ["market"]}],
            "relations": ["atNode"],
        },
        "NetworkNode": {"parents": ["SemanticEntity"], "attributes": ["name"], "relations": ["belongsToGeographicalRegion"]},
        "GeographicalRegion": {"parents": ["SemanticEntity"], "attributes": ["name"]},
        "GeneratorType": {"parents": ["SemanticEntity"], "attributes": ["brand", "size", "price", "name"]},
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """Reads each table's schema once, however often it is asked for."""
    return lru_cache(None)(lambda name: table(spark, sf_dir, name))


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix + "."), F.col(column).cast("string"))


def _paths(sf_dir: str, *names: str) -> list[str]:
    return [f"{sf_dir}/{n}.parquet" for n in names]


def star_model(spark: SparkSession, sf_dir: str) -> Model:
    """The star model in the storage layout, written once for a session."""
    return once(lambda: star_rows(spark, sf_dir), f"star {sf_dir}", _paths(sf_dir, "region", "nation", "supplier", "customer", "part"), spark)


def star_rows(spark: SparkSession, sf_dir: str) -> Model:
    """Suppliers with a balance above 5000 have the technology of the part with their number."""
    read = reader(spark, sf_dir)
    kinds = (
        ("GeographicalRegion", read("region"), key("region", "r_regionkey"), "r_regionkey", {"name": "r_name"}),
        ("NetworkNode", read("nation"), key("node", "n_nationkey"), "n_nationkey", {"name": "n_name"}),
        ("GenerationUnit", read("supplier"), key("gen", "s_suppkey"), "s_suppkey", {"name": "s_name", "nominal_power_capacity": "s_acctbal"}),
        ("DemandUnit", read("customer"), key("load", "c_custkey"), "c_custkey", {"name": "c_name", "annual_energy_demand": "c_acctbal", "segment": "c_mktsegment"}),
        ("GeneratorType", read("part"), key("tech", "p_partkey"), "p_partkey", {"name": "p_name", "brand": "p_brand", "size": "p_size", "price": "p_retailprice"}),
    )
    entity = attr = None
    for name, rows, ids, seq, columns in kinds:
        e = rows.select(F.lit(name).alias("entity_class"), ids.alias("entity_id"), F.lit(name == "GeneratorType").alias("is_library"), F.col(seq).cast("long").alias("seq"))
        a = attribute_rows(rows, name, ids, columns)
        entity, attr = (e, a) if entity is None else (entity.unionByName(e), attr.unionByName(a))
    technology = F.when(F.col("s_acctbal") > 5000, key("tech", "s_suppkey"))
    rel = relation_rows(read("nation"), "NetworkNode", key("node", "n_nationkey"), "belongsToGeographicalRegion", key("region", "n_regionkey"))
    rel = rel.union(relation_rows(read("supplier"), "GenerationUnit", key("gen", "s_suppkey"), "atNode", key("node", "s_nationkey")))
    rel = rel.union(relation_rows(read("supplier"), "GenerationUnit", key("gen", "s_suppkey"), "hasTechnology", technology))
    rel = rel.union(relation_rows(read("customer"), "DemandUnit", key("load", "c_custkey"), "atNode", key("node", "c_nationkey")))
    return Model(entity, attr, rel, spark.createDataFrame([], PROFILE), *Schema.composed([SCHEMA]).frames(spark))


def violating_model(spark: SparkSession, sf_dir: str) -> Model:
    """The star model with faults: labels that are no integers, units of the wrong kind, generators at regions, and
    technologies that do not exist."""
    m, customer, supplier = star_model(spark, sf_dir), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    tagged = customer.where("c_custkey % 11 = 0").withColumn("label", F.concat(F.lit("x"), F.col("c_custkey").cast("string")))
    attr = m.attr.unionByName(attribute_rows(tagged, "DemandUnit", key("load", "c_custkey"), {"label": "label"}))
    wrong = F.when(F.col("attribute_id") == "nominal_power_capacity", F.when(F.regexp_extract("entity_id", r"(\d+)", 1).cast("int") % 5 == 0, F.lit("kg")).otherwise("MW"))
    attr = attr.withColumn("unit", F.coalesce(wrong, "unit"))
    rel = m.rel.union(relation_rows(supplier.where("s_suppkey % 13 = 0"), "GenerationUnit", key("gen", "s_suppkey"), "atNode", F.lit("region.0")))
    rel = rel.union(relation_rows(supplier.where("s_suppkey % 17 = 0"), "GenerationUnit", key("gen", "s_suppkey"), "hasTechnology", key("lost", "s_suppkey")))
    return m.but(attr=attr, rel=rel)


POWER = {"type": "decimal", "constraints": {"minimum": 0}, "unit": "MW"}
ENERGY = {"type": "decimal", "unit": "MWh"}
ENERGY_SCHEMA = {
    "units": {"MW": {}, "MWh": {}, "kV": {}},
    "attributes": {
        "name": {"type": "string"},
        "nominal_power_capacity": POWER,
        "maximum_pumping_power": POWER,
        "annual_resource_potential": ENERGY,
        "annual_natural_inflow_energy": ENERGY,
        "annual_energy_demand": ENERGY,
        "energy_storage_capacity": ENERGY,
        "total_generation": ENERGY,
        "peak_output": POWER,
        "gain": {"type": "decimal"},
        "data_reference": {"type": "string"},
        "dispatch_type": {"type": "string", "constraints": {"enum": ["dispatchable", "nondispatchable"]}},
        "generator_technology_type": {"type": "string"},
    },
    "relations": {
        "atNode": {"target": "NetworkNode"},
        "fromNode": {"target": "NetworkNode"},
        "toNode": {"target": "NetworkNode"},
        "belongsToGeographicalRegion": {"target": "GeographicalRegion"},
        "drawsFromHydraulicStorage": {"target": "HydraulicStorageUnit"},
        "hasTechnology": {"target": "GeneratorType"},
        "hasOutputCarrier": {"target": "Carrier"},
        "hasAvailabilityProfile": {"target": "Profile"},
        "hasDemandProfile": {"target": "Profile"},
        "hasAutomaticVoltageRegulator": {"target": "Controller"},
    },
    "classes": {
        "SemanticEntity": {"abstract": True, "attributes": ["name"]},
        "EnergyAssetInstance": {"parents": ["SemanticEntity"], "abstract": True},
        "GenerationUnit": {"parents": ["EnergyAssetInstance"], "attributes": ["nominal_power_capacity", "annual_resource_potential", "dispatch_type", "generator_technology_type"], "relations": ["atNode", "hasTechnology", "hasOutputCarrier", "hasAvailabilityProfile", "hasAutomaticVoltageRegulator"]},
        "HydroGenerationUnit": {"parents": ["GenerationUnit"], "attributes": ["maximum_pumping_power"], "relations": ["drawsFromHydraulicStorage"]},
        "HydraulicStorageUnit": {"parents": ["EnergyAssetInstance"], "attributes": ["energy_storage_capacity", "annual_natural_inflow_energy"], "relations": ["atNode"]},
        "StorageUnit": {"parents": ["EnergyAssetInstance"], "attributes": ["energy_storage_capacity", "nominal_power_capacity"], "relations": ["atNode"]},
        "DemandUnit": {"parents": ["EnergyAssetInstance"], "attributes": ["annual_energy_demand"], "relations": ["atNode", "hasDemandProfile"]},
        "TransmissionLine": {"parents": ["EnergyAssetInstance"], "attributes": ["nominal_power_capacity"], "relations": ["fromNode", "toNode"]},
        "GenerationResult": {"parents": ["SemanticEntity"], "view_family": "dispatch", "attributes": ["total_generation"], "relations": [{"id": "reportsOn", "target": "GenerationUnit", "cardinality": "1"}]},
        "PeakResult": {"parents": ["SemanticEntity"], "view_family": "peak", "attributes": ["total_generation", "peak_output"], "relations": [{"id": "reportsOn", "target": "HydroGenerationUnit", "cardinality": "1"}]},
        "Controller": {"parents": ["SemanticEntity"], "abstract": True},
        "SimpleController": {"parents": ["Controller"], "view_family": "avr", "attributes": ["gain"]},
        "NetworkNode": {"parents": ["SemanticEntity"], "abstract": True, "relations": ["belongsToGeographicalRegion"]},
        "ElectricalBus": {"parents": ["NetworkNode"]},
        "GeographicalRegion": {"parents": ["SemanticEntity"]},
        "Carrier": {"parents": ["SemanticEntity"]},
        "Profile": {"parents": ["SemanticEntity"], "attributes": ["data_reference"]},
        "GeneratorType": {"parents": ["SemanticEntity"], "relations": ["hasOutputCarrier"]},
    },
}


def energy_model(spark: SparkSession, sf_dir: str) -> Model:
    """The energy model in the storage layout, written once for a session."""
    return once(lambda: energy_rows(spark, sf_dir), f"energy {sf_dir}", _paths(sf_dir, "nation", "supplier", "customer", "orders", "part"), spark)


def energy_rows(spark: SparkSession, sf_dir: str) -> Model:
    """An energy system over the star tables. Nations are buses `node.<code>.<key>`, those with an even key in a region.
    Suppliers are generators, every third a hydro one that draws from a reservoir; every other one is variable. Every
    fiftieth customer is a reservoir, some with a bus of their own, the next one a store, the others demand. Orders are lines between buses, of
    which some do not exist. Every fourth supplier has a result, every eighth hydro one two of them, every fifth a
    controller."""
    read = reader(spark, sf_dir)
    n, s, c, o = read("nation"), read("supplier"), read("customer"), read("orders")
    code = F.concat(F.lower(F.substring("n_name", 1, 2)), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    n = n.withColumn("code", code).withColumn("bus", F.concat(F.lit("node."), "code", F.lit("."), F.col("n_nationkey").cast("string")))
    at = n.select(F.col("n_nationkey").alias("nation"), "bus")
    s = s.join(at, F.col("s_nationkey") == F.col("nation")).withColumns({"hydro": F.col("s_suppkey") % 3 == 0, "variable": F.col("s_suppkey") % 2 == 0})
    c = c.join(at, F.col("c_nationkey") == F.col("nation"))
    of = lambda rows, class_, ids, seq: rows.select(F.lit(class_).alias("entity_class"), ids.alias("entity_id"), F.lit(class_ == "GeneratorType").alias("is_library"), seq.cast("long").alias("seq"))
    parts, values, edges = [], [], []

    def add(rows: DataFrame, class_: str, ids, seq: str, attributes: dict, relations: dict) -> None:
        parts.append(of(rows, class_, ids, F.col(seq)))
        wide = rows.select(ids.alias("id"), *(v.alias(k) for k, v in attributes.items()))
        if attributes:
            values.append(attribute_rows(wide, class_, F.col("id"), {k: k for k in attributes}))
        edges.extend(relation_rows(rows, class_, ids, k, v) for k, v in relations.items())

    add(n, "ElectricalBus", F.col("bus"), "n_nationkey", {"name": F.col("n_name")}, {"belongsToGeographicalRegion": F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("region.nuts3."), "code"))})
    add(n.where("n_nationkey % 2 = 0"), "GeographicalRegion", F.concat(F.lit("region.nuts3."), "code"), "n_nationkey", {"name": F.upper("code")}, {})
    generator = {"nominal_power_capacity": F.col("s_acctbal"), "annual_resource_potential": F.when(F.col("variable"), F.col("s_acctbal") * 2), "dispatch_type": F.when(F.col("variable"), "nondispatchable").otherwise("dispatchable"), "generator_technology_type": F.when(F.col("s_suppkey") % 5 == 0, "wind_onshore").when(F.col("s_suppkey") % 5 == 1, "solar_pv")}
    link = {"atNode": F.col("bus"), "hasTechnology": F.when(F.col("s_suppkey") % 7 == 0, key("tech", "s_suppkey")), "hasOutputCarrier": F.when(F.col("s_suppkey") % 14 == 0, F.lit("carrier.own")), "hasAvailabilityProfile": F.when(F.col("variable"), key("profile", "s_nationkey")), "hasAutomaticVoltageRegulator": F.when(F.col("s_suppkey") % 5 == 0, key("avr", "s_suppkey"))}
    add(s.where("NOT hydro"), "GenerationUnit", key("gen", "s_suppkey"), "s_suppkey", generator, link)
    hydro = s.where("hydro")
    reservoir = F.concat(F.lit("res."), (F.col("s_suppkey") % 4 * 50 + 50).cast("string"))
    add(hydro, "HydroGenerationUnit", key("gen", "s_suppkey"), "s_suppkey", generator | {"maximum_pumping_power": F.when(F.col("s_suppkey") % 9 == 0, 10.0)}, link | {"drawsFromHydraulicStorage": F.when(F.col("s_suppkey") % 2 == 1, reservoir)})
    add(c.where("c_custkey % 50 = 0"), "HydraulicStorageUnit", key("res", "c_custkey"), "c_custkey", {"energy_storage_capacity": F.col("c_acctbal"), "annual_natural_inflow_energy": F.col("c_acctbal") * 2}, {"atNode": F.when(F.col("c_custkey") % 150 == 0, F.col("bus"))})
    add(c.where("c_custkey % 50 = 1"), "StorageUnit", key("store", "c_custkey"), "c_custkey", {"energy_storage_capacity": F.col("c_acctbal"), "nominal_power_capacity": F.lit(5.0)}, {"atNode": F.col("bus")})
    add(c.where("c_custkey % 50 > 1"), "DemandUnit", key("load", "c_custkey"), "c_custkey", {"annual_energy_demand": F.col("c_acctbal")}, {"atNode": F.col("bus"), "hasDemandProfile": F.when(F.col("c_custkey") % 3 == 0, key("profile", "c_nationkey"))})
    ends = o.select("o_orderkey", (F.col("o_custkey") % 25).alias("a"), (F.col("o_orderkey") % 30).alias("b"), "o_totalprice").join(at.toDF("a", "from_bus"), "a", "left").join(at.toDF("b", "to_bus"), "b", "left")
    add(ends, "TransmissionLine", key("line", "o_orderkey"), "o_orderkey", {"nominal_power_capacity": F.col("o_totalprice")}, {"fromNode": F.col("from_bus"), "toNode": F.col("to_bus")})
    add(s.where("s_suppkey % 4 = 0"), "GenerationResult", key("result", "s_suppkey"), "s_suppkey", {"total_generation": F.when(F.col("s_suppkey") % 8 == 0, F.col("s_acctbal"))}, {"reportsOn": key("gen", "s_suppkey")})
    add(hydro.where("s_suppkey % 8 = 0"), "PeakResult", key("peak", "s_suppkey"), "s_suppkey", {"peak_output": F.col("s_acctbal")}, {"reportsOn": key("gen", "s_suppkey")})
    add(s.where("s_suppkey % 5 = 0"), "SimpleController", key("avr", "s_suppkey"), "s_suppkey", {"gain": F.when(F.col("s_suppkey") % 10 == 0, F.col("s_suppkey").cast("double"))}, {})
    add(n, "Profile", key("profile", "n_nationkey"), "n_nationkey", {"data_reference": F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("file:/"), F.col("n_nationkey").cast("string")))}, {})
    add(read("part").where("p_partkey % 7 = 0"), "GeneratorType", key("tech", "p_partkey"), "p_partkey", {"name": F.col("p_name")}, {"hasOutputCarrier": F.lit("carrier.electricity")})
    entity, attr, rel = parts[0], values[0], edges[0]
    for p in parts[1:]:
        entity = entity.unionByName(p)
    for v in values[1:]:
        attr = attr.unionByName(v)
    for e in edges[1:]:
        rel = rel.unionByName(e)
    series = n.select(key("profile", "n_nationkey").alias("profile_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t"), F.col("n_nationkey").cast("double").alias("value"))
    return Model(entity, attr, rel, series, *Schema.composed([ENERGY_SCHEMA]).frames(spark))
