import pytest
from pyspark.sql import functions as F

from edgeloom.model import ATTRIBUTE, PROFILE, RELATION
from edgeloom.operators import navigation, rolled_model, rollup
from edgeloom.plans import validation
from edgeloom.sources.star import energy_model

DATA = "/root/testdata/sf0.001"


def small(spark):
    """Two buses of one region and one of a country that stays as it is."""
    m = energy_model(spark, DATA)
    ids = {"ElectricalBus": ["node.de111.1", "node.de111.2", "node.fr101.3"], "GenerationUnit": ["g1", "g2", "g3", "g4"], "HydroGenerationUnit": ["h1", "h2", "h3"], "HydraulicStorageUnit": ["r1", "r2"], "StorageUnit": ["s1", "s2"], "DemandUnit": ["d1", "d2", "d3"], "Profile": ["p1", "p2"], "TransmissionLine": ["l1", "l2", "l3"]}
    rows = [(c, i, False, k) for c, v in ids.items() for k, i in enumerate(v)]
    of = {i: c for c, v in ids.items() for i in v}
    numbers = {
        "nominal_power_capacity": {"g1": 10.0, "g2": 30.0, "g3": 5.0, "g4": 7.0, "h1": 4.0, "h2": 6.0, "h3": 2.0, "s1": 2.0, "s2": 6.0},
        "energy_conversion_efficiency": {"g1": 0.4, "g2": 0.8}, "turbine_efficiency": {"h1": 0.5, "h2": 1.0}, "maximum_pumping_power": {"h3": 3.0}, "pumping_efficiency": {"h3": 0.7},
        "energy_storage_capacity": {"r1": 100.0, "r2": 50.0, "s1": 8.0, "s2": 8.0}, "annual_natural_inflow_energy": {"r1": 20.0, "r2": 10.0}, "maximum_charging_power": {"s1": 1.0, "s2": 3.0},
        "charging_variable_operating_cost": {"s1": 4.0, "s2": 8.0}, "annual_energy_demand": {"d1": 100.0, "d2": 300.0, "d3": 9.0}, "nominal_voltage": {"node.de111.1": 380.0, "node.de111.2": 380.0},
    }
    texts = {"dispatch_type": {"g1": "dispatchable", "g2": "nondispatchable"}, "generator_technology_type": {"g1": "Gas", "g2": "Gas", "g3": "Gas.New", "g4": "Wind"}, "name": {"g3": "third"}, "hydro_machine_kind": {"h1": "turbine", "h2": "turbine"}}
    attr = [(of[i], i, a, str(v), v, None, None, None) for a, x in numbers.items() for i, v in x.items()] + [(of[i], i, a, v, None, None, None, None) for a, x in texts.items() for i, v in x.items()]
    at = dict.fromkeys(("g1", "h1", "h3", "s1", "d1"), "node.de111.1") | dict.fromkeys(("g2", "h2", "s2", "d2"), "node.de111.2") | dict.fromkeys(("g3", "g4", "d3"), "node.fr101.3")
    rel = [("atNode", i, n) for i, n in at.items()] + [("drawsFromHydraulicStorage", "h1", "r1"), ("drawsFromHydraulicStorage", "h2", "r1"), ("drawsFromHydraulicStorage", "h3", "r2")]
    rel += [("hasDemandProfile", "d1", "p1"), ("hasDemandProfile", "d2", "p2"), ("hasDemandProfile", "d3", "p1"), ("hasAvailabilityProfile", "g1", "p1"), ("hasAvailabilityProfile", "g2", "p2"), ("hasNaturalInflowProfile", "r1", "p2")]
    rel += [(r, i, n) for i, (a, b) in {"l1": ("node.de111.1", "node.de111.2"), "l2": ("node.de111.1", "node.fr101.3"), "l3": ("node.de111.1", "nowhere")}.items() for r, n in (("fromNode", a), ("toNode", b))]
    series = [("p1", 0, -1.0), ("p1", 1, -3.0), ("p2", 0, -2.0), ("p2", 1, 0.0)]
    return m.but(entity=spark.createDataFrame(rows, m.entity.schema), attr=spark.createDataFrame(attr, ATTRIBUTE), rel=spark.createDataFrame([(of[i], i, r, n, 0) for r, i, n in rel], RELATION), profile_value=spark.createDataFrame(series, PROFILE))


@pytest.fixture(scope="module")
def rolled(spark):
    m = small(spark)
    out = rolled_model.rolled_model(m, rollup.bus_map(rolled_model.model_buses(m), overrides={"FR": "disaggregated"}), {"gas": ["Gas"]})
    rows = {r["entity_id"]: r["entity_class"] for r in out.entity.collect()}
    attr = {(r["entity_id"], r["attribute_id"]): r["value_str"] if r["value_num"] is None else r["value_num"] for r in out.attr.collect()}
    rel = sorted((r["entity_id"], r["relation_id"], r["target_id"]) for r in out.rel.collect())
    series = {(r["profile_id"], r["t"]): round(r["value"], 6) for r in out.profile_value.collect()}
    return rows, attr, rel, series


def test_assets_are_merged_or_passed_through(rolled):
    rows, attr, _, _ = rolled
    gas, water, pumped = "gen.gas.agg.de.380", "gen.hydrogenerationunit.nonphs.agg.de.380", "gen.hydrogenerationunit.phs.agg.de.380"
    store = "storage.storageunit.agg.de.380"
    made = {gas: "GenerationUnit", water: "HydroGenerationUnit", pumped: "HydroGenerationUnit", "gen.gas.agg.fr101.3": "GenerationUnit", "g4": "GenerationUnit", store: "StorageUnit", "demand.agg.de.380": "DemandUnit", "d3": "DemandUnit"}
    made |= {f"storage.hydraulicstorageunit.{x}.agg.de.380": "HydraulicStorageUnit" for x in ("phs", "nonphs")}
    assert {i: c for i, c in rows.items() if c.endswith("Unit")} == made
    assert attr[gas, "nominal_power_capacity"] == 40 and round(attr[gas, "energy_conversion_efficiency"], 6) == 0.7 and attr[gas, "dispatch_type"] == "dispatchable"
    assert round(attr[water, "turbine_efficiency"], 6) == 0.8 and attr[water, "hydro_machine_kind"] == "turbine" and (water, "maximum_pumping_power") not in attr
    assert attr[pumped, "maximum_pumping_power"] == 3 and round(attr[pumped, "pumping_efficiency"], 6) == 0.7
    assert attr[store, "charging_variable_operating_cost"] == 7 and attr[store, "nominal_power_capacity"] == 8
    assert attr["g4", "generator_technology_type"] == "Wind" and ("g3", "name") not in attr and attr["gen.gas.agg.fr101.3", "nominal_power_capacity"] == 5
    assert attr["demand.agg.de.380", "annual_energy_demand"] == 400 and attr["d3", "annual_energy_demand"] == 9


def test_relations_lead_to_what_is_there(rolled):
    rows, _, rel, _ = rolled
    assert ("gen.hydrogenerationunit.nonphs.agg.de.380", "drawsFromHydraulicStorage", "storage.hydraulicstorageunit.nonphs.agg.de.380") in rel
    assert ("g4", "atNode", "node.fr101.3") in rel and ("gen.gas.agg.de.380", "atNode", "node.de.380") in rel
    assert [r for r in rel if r[0].startswith("l")] == [("l2", "fromNode", "node.de.380"), ("l2", "toNode", "node.fr101.3")]
    assert {t for _, _, t in rel} <= set(rows) and len(rel) == len(set(rel))
    assert {i for i, c in rows.items() if c == "ElectricalBus"} == {"node.de.380", "node.fr101.3"} and rows["region.country.de"] == "GeographicalRegion"


def test_series_are_combined_or_copied(rolled):
    rows, _, rel, series = rolled
    assert ("demand.agg.de.380", "hasDemandProfile", "profile.demand.de.380") in rel and ("d3", "hasDemandProfile", "p1") in rel
    assert (series["profile.demand.de.380", 0], series["profile.demand.de.380", 1]) == (-0.7, -0.3)
    assert series["p1", 1] == -3 and ("p2", 0) not in series and rows["p1"] == "Profile" and "p2" not in rows
    assert series["profile.gen.gas.de.380", 0] == -1.75 and ("gen.gas.agg.de.380", "hasAvailabilityProfile", "profile.gen.gas.de.380") in rel
    assert series["profile.inflow.hydraulicstorageunit.nonphs.de.380", 0] == 1


def test_totals_are_kept(spark):
    m = energy_model(spark, DATA)
    for more in ({"overrides": {"AL": "disaggregated"}}, {"level": "nuts1"}):
        out = rolled_model.rolled_model(m, rollup.bus_map(rolled_model.model_buses(m), **more), {"w": ["wind*"]})
        for a in ("nominal_power_capacity", "annual_energy_demand", "energy_storage_capacity"):
            total = lambda x: x.attr.where((F.col("attribute_id") == a) & ~F.col("entity_class").isin("TransmissionLine", "HydraulicStorageUnit")).agg(F.round(F.sum("value_num"), 2)).first()[0]  # noqa: E731,B023
            assert total(m) == total(out), a
        assert out.entity.groupBy("entity_id").count().where("count > 1").isEmpty()
        assert validation.dangling(out.but(rel=out.rel.where(~F.col("relation_id").isin("hasTechnology", "hasOutputCarrier", "hasAutomaticVoltageRegulator")))).isEmpty()
        assert navigation.entities(out, "GenerationUnit", derived=True).count() > 0
