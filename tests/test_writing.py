"""Checked writing, the audit of a schema, and inflows of stores and generators."""

import pytest
from pyspark.sql import functions as F

from edgeloom.model import PROFILE
from edgeloom.operators import etl, market, mutation, rollup
from edgeloom.plans import validation
from edgeloom.plans.schema import Schema, empty_model

from .test_model import build

ROWS = "entity_id string, attribute_id string, value_str string, unit string, ord long"
FIELDS = {
    "units": {"kg": {}, "t": {}},
    "attributes": {
        "mass": {"type": "decimal", "constraints": {"minimum": 0}, "unit": {"constraints": {"enum": ["kg", "t"]}}},
        "count": {"type": "integer"},
        "open": {"type": "boolean"},
        "code": {"type": "string", "constraints": {"pattern": "[a-z]+"}},
    },
    "classes": {"Thing": {"attributes": ["mass", "count", "open", "code"]}},
}


def values(m):
    return {(r["entity_id"], r["attribute_id"]): (r["value_str"], r["value_num"], r["value_bool"], r["unit"]) for r in m.attr.collect()}


def test_values_are_coerced_and_the_last_one_stays(spark):
    m = build(spark, [("a", "Thing")], [("a", "code", "old")], source=FIELDS)
    rows = [("a", "mass", " 1,5 ", None, 0), ("a", "count", "3.9", None, 0), ("a", "open", "YES", None, 0), ("a", "code", "first", None, 1), ("a", "code", "second", None, 2), ("a", "code", "9", None, 3)]
    out, side = mutation.write_attributes(m, spark.createDataFrame(rows, ROWS))
    assert values(out) == {("a", "mass"): ("1.5", 1.5, None, "kg"), ("a", "count"): ("3", 3.0, None, None), ("a", "open"): ("true", None, True, None), ("a", "code"): ("second", None, None, None)}
    assert [(r["field_id"], r["rule"], r["policy"]) for r in side.collect()] == [("code", "pattern", "rejected")]


def test_policies(spark):
    m = build(spark, [("a", "Thing")], source=FIELDS)
    rows = spark.createDataFrame([("a", "mass", "-1", "t", 0), ("a", "mass", "7", "lb", 1), ("a", "open", "maybe", None, 0), ("a", "colour", "red", None, 0), ("b", "mass", "1", None, 0), (None, "mass", "1", None, 0), ("a", "count", None, None, 0), ("a", "code", "", None, 0)], ROWS)
    out, side = mutation.write_attributes(m, rows)
    assert {(r["entity_id"], r["field_id"], r["rule"], r["policy"]) for r in side.collect()} == {
        ("a", "mass", "minimum", "reported"), ("a", "mass", "unit", "rejected"), ("a", "open", "type", "rejected"), ("a", "colour", "field", "rejected"),
        ("b", "mass", "entity", "rejected"), (None, "mass", "entity", "rejected"), ("a", "code", "pattern", "rejected"),
    }
    assert values(out) == {("a", "mass"): ("-1.0", -1.0, None, "t"), ("a", "count"): ("", None, None, None)}
    with pytest.raises(validation.ValidationError, match="unit 'mass' lb"):
        mutation.write_attributes(m, rows, strict=True)
    kept, _ = mutation.write_attributes(m, rows.where("value_str = '-1'"), strict=True)
    assert values(kept) == {("a", "mass"): ("-1.0", -1.0, None, "t")}


def test_nothing_to_write(spark):
    m = build(spark, [("a", "Thing")], [("a", "code", "old")], source=FIELDS)
    out, side = mutation.write_attributes(m, spark.createDataFrame([], "entity_id string, attribute_id string, value_str string"))
    assert side.isEmpty() and set(values(out)) == {("a", "code")}


def test_audit_of_an_empty_model(spark):
    found = validation.audit(empty_model(spark, Schema.composed([FIELDS]))).collect()
    assert {(r["finding"], r["class_name"], r["field_id"]) for r in found} == {("orphan class", "Thing", None), *(("dead attribute", None, f) for f in FIELDS["attributes"])}


WATER = {
    "attributes": {"annual_resource_potential": {"type": "decimal"}, "annual_natural_inflow_energy": {"type": "decimal"}},
    "relations": {"drawsFromHydraulicStorage": {"target": "HydraulicStorageUnit"}},
    "classes": {
        "HydroGenerationUnit": {"attributes": ["annual_resource_potential"], "relations": ["drawsFromHydraulicStorage"]},
        "HydraulicStorageUnit": {"attributes": ["annual_natural_inflow_energy"]},
        "Profile": {},
    },
}


def series(spark, **given):
    return spark.createDataFrame([(k, t, v) for k, vs in given.items() for t, v in enumerate(vs)], "entity_id string, t int, value double")


def test_inflows_go_to_stores_and_their_generators(spark):
    entities = [("g1", "HydroGenerationUnit"), ("g2", "HydroGenerationUnit"), ("g3", "HydroGenerationUnit"), ("g4", "HydroGenerationUnit"), ("r1", "HydraulicStorageUnit"), ("r2", "HydraulicStorageUnit"), ("r3", "HydraulicStorageUnit")]
    draws = [("g2", "drawsFromHydraulicStorage", "r1"), ("g1", "drawsFromHydraulicStorage", "r1"), ("g3", "drawsFromHydraulicStorage", "r2")]
    m = build(spark, entities, edges=draws, source=WATER).but(profile_value=spark.createDataFrame([("profile.inflow.r1", 0, 9.0), ("other", 0, 1.0)], PROFILE))
    out = market.assign_inflows(m, series(spark, r1=[1.0, 3.0], g3=[2.0, 2.0], g4=[5.0, 0.0], r3=[0.0, 0.0], lost=[1.0, 1.0]))
    assert {k: v[1] for k, v in values(out).items()} == {("r1", "annual_natural_inflow_energy"): 4.0, ("g1", "annual_resource_potential"): 4.0, ("g3", "annual_resource_potential"): 4.0, ("g4", "annual_resource_potential"): 5.0}
    edges = {(r["entity_id"], r["relation_id"], r["target_id"]) for r in out.rel.where("relation_id <> 'drawsFromHydraulicStorage'").collect()}
    assert edges == {("r1", "hasNaturalInflowProfile", "profile.inflow.r1"), ("r2", "hasNaturalInflowProfile", "profile.inflow.g3"), ("g4", "hasAvailabilityProfile", "profile.inflow.g4")}
    found = {(r["profile_id"], r["t"]): r["value"] for r in out.profile_value.collect()}
    assert found == {("other", 0): 1.0, ("profile.inflow.r1", 0): 0.25, ("profile.inflow.r1", 1): 0.75, ("profile.inflow.g3", 0): 0.5, ("profile.inflow.g3", 1): 0.5, ("profile.inflow.g4", 0): 1.0, ("profile.inflow.g4", 1): 0.0}
    assert {r[0] for r in out.entity.where("entity_class = 'Profile'").select("entity_id").collect()} == {"profile.inflow.r1", "profile.inflow.g3", "profile.inflow.g4"}


def test_pairs_may_be_given(spark):
    m = build(spark, [("s.x", "HydraulicStorageUnit"), ("gen.hydro.s.x", "HydroGenerationUnit")], source=WATER)
    pairs = m.entity.where("entity_class = 'HydraulicStorageUnit'").select(F.col("entity_id").alias("storage"), F.concat(F.lit("gen.hydro."), "entity_id").alias("generator"))
    out = market.assign_inflows(m, series(spark, **{"s.x": [1.0, 1.0]}), pairs)
    assert values(out)[("gen.hydro.s.x", "annual_resource_potential")][1] == 2.0
    assert market.assign_inflows(m, series(spark).limit(0), pairs).attr.isEmpty()


def test_inflow_files(spark):
    rows = spark.createDataFrame([("CH 00", "PS Cloase", "1", "2"), ("CH 00", "PS Close", "1", "x"), ("CH 00", "Run of River", "3", "4"), ("CH 00", "Wind", "3", "4"), ("CH 00", None, "3", "4")], "Node string, Type string, `0` string, `1` string")
    found = {(r["entity_id"], r["t"]): r["value"] for r in market.inflow_series(rows, ["0", "1"]).collect()}
    assert found == {("tech.pump_storage_closed_loop.ch.00", 0): 2.0, ("tech.pump_storage_closed_loop.ch.00", 1): 2.0, ("tech.run_of_river.ch.00", 0): 3.0, ("tech.run_of_river.ch.00", 1): 4.0}


def test_reservoirs_without_inflow(spark):
    m = build(spark, [(r, "HydraulicStorageUnit") for r in "abcd"], [("a", "annual_natural_inflow_energy", "5")], [("b", "hasNaturalInflowProfile", "p")], source=WATER)
    pumped = spark.createDataFrame([("c",)], "entity_id string")
    assert [r["entity_id"] for r in etl.without_inflow(m, pumped).collect()] == ["d"]


def test_links_of_merged_stores(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    stores = frame([("r1", "R"), ("r2", "R"), ("r3", "S")], "reservoir string, storage_group string")
    links = rollup.storage_links(frame([("g1", "r1"), ("g2", "r2")], "entity_id string, reservoir string"), frame([("g1", "G"), ("g2", "G")], "entity_id string, generator_group string"), stores)
    assert [tuple(r) for r in links.collect()] == [("G", "R")]
    assert [r["reservoir"] for r in rollup.orphan_groups(stores, links).collect()] == ["r3"]
