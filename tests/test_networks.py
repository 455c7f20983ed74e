"""Component tables and MATPOWER matrices to a model and back."""

import pytest

from edgeloom.operators import navigation
from edgeloom.plans.schema import Schema, empty_model
from edgeloom.sources import networks, readers, regions, writers

NUMBERS = [
    "nominal_voltage", "longitude", "latitude", "nominal_power_capacity", "active_power_setpoint", "reactive_power_setpoint", "maximum_reactive_power_output", "minimum_reactive_power_output",
    "voltage_magnitude_setpoint", "maximum_power_output", "minimum_power_output", "active_power_demand", "reactive_power_demand", "active_power_injection", "reactive_power_injection", "line_length",
    "series_resistance_per_km", "series_reactance_per_km", "shunt_susceptance_per_km", "parallel_circuit_count", "thermal_capacity_rating", "rated_primary_voltage", "rated_secondary_voltage",
    "short_circuit_voltage_in_percentage", "tap_ratio", "phase_shift_angle", "energy_storage_capacity", "annual_natural_inflow_energy", "charging_efficiency", "discharging_efficiency",
    "energy_conversion_efficiency", "variable_operating_cost", "max_flow", "flow_coefficient",
]
TEXTS = ["name", "long_name", "powerflow_bus_type", "line_parameter_basis", "dispatch_type", "hydro_machine_kind", "generator_technology_type", "storage_technology_type", "market_zone_code", "region_level", "nuts_code", "iso_country_code", "port_direction", "profile_kind"]
RELATIONS = ["atNode", "fromNode", "toNode", "hasTechnology", "hasInputCarrier", "hasOutputCarrier", "hasCarrier", "coversRegion", "isSubRegionOf", "belongsToGeographicalRegion", "belongsToCarrierDomain", "drawsFromHydraulicStorage", "storesCarrier", "belongsToUnit", "referencePort", "hasNaturalInflowProfile"]
ALL = {"attributes": NUMBERS + TEXTS, "relations": RELATIONS}
CLASSES = ("ElectricalBus", "DemandUnit", "ShuntUnit", "GenerationUnit", "HydroGenerationUnit", "HydraulicStorageUnit", "StorageUnit", "TransmissionLine", "Transformer", "Carrier", "GeographicalRegion", "MarketZone", "HVDCLink", "GenericConversionUnit", "ConversionPort", "Profile")
SOURCE = {"attributes": {a: {"type": "decimal"} for a in NUMBERS} | {a: {"type": "string"} for a in TEXTS}, "relations": {r: {"target": "Thing"} for r in RELATIONS}, "classes": {"Thing": {"abstract": True}} | {c: {"parents": ["Thing"], **ALL} for c in CLASSES}}


@pytest.fixture(scope="module")
def empty(spark):
    return empty_model(spark, Schema.composed([SOURCE]))


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture(scope="module")
def grid(spark):
    return {
        "bus": frame(spark, "index long, name string, vn_kv double, in_service boolean", (0, "north", 110.0, True), (1, "south", 110.0, True), (2, "low", 20.0, True), (3, "off", 110.0, False)),
        "load": frame(spark, "index long, bus long, p_mw double, q_mvar double", (0, 1, 30.0, 5.0), (1, 3, 9.0, 1.0)),
        "gen": frame(spark, "index long, bus long, p_mw double, vm_pu double, max_p_mw double", (0, 1, 20.0, 1.02, 50.0)),
        "ext_grid": frame(spark, "index long, bus long, vm_pu double", (0, 0, 1.0)),
        "shunt": frame(spark, "index long, bus long, p_mw double, q_mvar double", (0, 2, 0.0, -4.0)),
        "line": frame(spark, "index long, from_bus long, to_bus long, length_km double, r_ohm_per_km double, x_ohm_per_km double, c_nf_per_km double, max_i_ka double", (0, 0, 1, 10.0, 0.1, 0.4, 9.0, 0.5), (1, 0, 3, 1.0, 0.1, 0.1, 1.0, 1.0)),
        "trafo": frame(spark, "index long, hv_bus long, lv_bus long, sn_mva double, vn_hv_kv double, vn_lv_kv double, vk_percent double, vkr_percent double", (0, 1, 2, 40.0, 110.0, 20.0, 12.0, 0.5)),
    }


def counts(m):
    return {r["entity_class"]: r["count"] for r in m.entity.groupBy("entity_class").count().collect()}


def value(m, entity, attribute):
    r = m.attr.where(f"entity_id = '{entity}' AND attribute_id = '{attribute}'").collect()
    return r[0]["value_num"] if r and r[0]["value_num"] is not None else r[0]["value_str"] if r else None


def test_component_tables_with_indices(empty, grid):
    m = networks.from_pandapower(empty, grid)
    assert counts(m) == {"ElectricalBus": 3, "DemandUnit": 1, "GenerationUnit": 2, "ShuntUnit": 1, "TransmissionLine": 1, "Transformer": 1}
    assert value(m, "pp.bus.0", "powerflow_bus_type") == "slack" and value(m, "pp.bus.1", "powerflow_bus_type") == "PV"
    assert value(m, "pp.gen.0", "nominal_power_capacity") == 50.0 and value(m, "pp.shunt.0", "reactive_power_injection") == 4.0
    assert value(m, "pp.line.0", "thermal_capacity_rating") == pytest.approx(3**0.5 * 110 * 0.5)
    assert value(m, "pp.line.0", "shunt_susceptance_per_km") == pytest.approx(2 * 3.141592653589793 * 50 * 9.0 * 1e-3)
    z = 110.0**2 / 40
    assert value(m, "pp.trafo.0", "series_reactance_per_km") == pytest.approx((0.12**2 - 0.005**2) ** 0.5 * z)
    assert {r["entity_id"]: (r["from_node"], r["to_node"]) for r in navigation.branch_ends(m).collect()}["pp.trafo.0"] == ("pp.bus.1", "pp.bus.2")
    assert networks.imported_problems(m).isEmpty()
    back = networks.to_pandapower(m)
    line, trafo = back["line"].first(), back["trafo"].first()
    assert (line["length_km"], line["r_ohm_per_km"], line["c_nf_per_km"], line["max_i_ka"]) == pytest.approx((10.0, 0.1, 9.0, 0.5))
    assert (trafo["sn_mva"], trafo["vk_percent"], trafo["vkr_percent"]) == pytest.approx((40.0, 12.0, 0.5))
    assert sorted(r["index"] for r in back["bus"].collect()) == [0, 1, 2] and back["load"].first()["p_mw"] == 30.0


def test_matrices_there_and_back(spark, empty, grid, tmp_path):
    m = networks.from_pandapower(empty, grid)
    case = networks.matpower_case(m)
    assert networks.case_problems(case, buses=3, branches=2, generators=2).isEmpty()
    assert sorted((r["number"], r["type"]) for r in case["bus"].collect()) == [(1, 3), (2, 2), (3, 1)]
    text = writers.matpower_text({k: [[float(x) for x in r] for r in case[k].collect()] for k in ("bus", "gen", "branch")})
    (tmp_path / "case.m").write_text(text)
    again = networks.from_matpower(empty, readers.read_matpower(spark, f"{tmp_path}/case.m"))
    assert counts(again) == {"ElectricalBus": 3, "DemandUnit": 1, "GenerationUnit": 2, "ShuntUnit": 1, "TransmissionLine": 2}
    second = networks.matpower_case(again)
    for t, columns in (("branch", ["from_bus", "to_bus", "r", "x", "b", "rate_a"]), ("gen", ["bus", "pg", "pmax", "vg"]), ("bus", ["number", "type", "pd", "qd", "bs", "base_kv"])):
        first, then = (sorted([float(f"{x:.7g}") for x in r] for r in c[t].select(*columns).collect()) for c in (case, second))
        assert first == [pytest.approx(r, rel=1e-6) for r in then]


def test_problems_of_a_case(spark, empty, grid):
    case = networks.matpower_case(networks.from_pandapower(empty, grid))
    broken = case | {"bus": case["bus"].where("number > 1")}
    assert {r["problem"] for r in networks.case_problems(broken, buses=3).collect()} == {"3 rows of bus, not 2", "no slack bus", "gen refers to the missing bus 1", "branch refers to the missing bus 1"}


def test_component_tables_with_names(spark, empty):
    tables = {
        "buses": frame(spark, "name string, v_nom double, x double, y double, country string", ("A 1", 380.0, 8.0, 47.0, "CH"), ("B", 380.0, 9.0, 48.0, None)),
        "lines": frame(spark, "name string, bus0 string, bus1 string, length double, r double, x double, s_nom double", ("l", "A 1", "B", 10.0, 1.0, 4.0, 100.0)),
        "loads": frame(spark, "name string, bus string, p_set double, carrier string", ("d", "B", 5.0, "AC")),
        "generators": frame(spark, "name string, bus string, carrier string, p_nom double, p_max_pu double", ("g", "A 1", "CCGT", 0.0, None), ("w", "B", "onwind", 7.0, 0.5), ("w0", "B", "onwind", 0.0, 1.0), ("s0", "B", "solar-hsat", 3.0, None), ("r", "A 1", "ror", 2.0, None)),
        "storage_units": frame(spark, "name string, bus string, carrier string, p_nom double, max_hours double", ("b", "A 1", "battery", 2.0, 4.0), ("p", "B", "PHS", 3.0, 6.0)),
    }
    series = frame(spark, "name string, t int, value double", ("s0", 0, 0.0), ("s0", 1, 0.0), ("r", 0, 0.4))
    m = networks.from_components(empty, tables, series)
    assert counts(m) == {"ElectricalBus": 2, "TransmissionLine": 1, "DemandUnit": 1, "GenerationUnit": 3, "HydroGenerationUnit": 1, "HydraulicStorageUnit": 1, "StorageUnit": 1, "Carrier": 7}
    assert value(m, "generator.w", "dispatch_type") == "nondispatchable" and value(m, "generator.g", "dispatch_type") == "dispatchable"
    assert value(m, "storage.b", "energy_storage_capacity") == 8.0 and value(m, "hydro.reservoir.p", "hydro_machine_kind") == "reversible"
    assert value(m, "line.l", "series_reactance_per_km") == pytest.approx(0.4)
    draws = m.rel.where("relation_id = 'drawsFromHydraulicStorage'").collect()
    assert [(r["entity_id"], r["target_id"]) for r in draws] == [("hydro.reservoir.p", "reservoir.p")]


def test_stores_and_links(spark, empty):
    tables = {
        "buses": frame(spark, "name string, v_nom double, carrier string", ("A", 380.0, None), ("B", 380.0, "AC"), ("H", None, "H2"), ("W", None, "heat")),
        "stores": frame(spark, "name string, bus string, carrier string, e_nom double", ("t", "H", "H2 tank", 9.0), ("dry", "A", "reservoir", 5.0), ("wet", "A", "hydro dam", 7.0), ("p", "B", "PHS", 3.0)),
        "links": frame(spark, "name string, bus0 string, bus1 string, bus2 string, p_nom double, p_max_pu double, efficiency double, efficiency2 double, marginal_cost double, carrier string",
            ("dc", "A", "B", None, 10.0, 0.5, None, None, 2.0, "DC"), ("el", "A", "H", "W", 4.0, None, 0.7, 0.2, None, "electrolysis"), ("x", "A", "nowhere", None, 1.0, None, None, None, None, "DC"), ("y", None, "H", "", 1.0, None, 0.5, None, None, None)),
    }
    inflows = frame(spark, "name string, t int, value double", ("wet", 0, 1.0), ("wet", 1, 3.0), ("dry", 0, 0.0), ("t", 0, 2.0))
    m = networks.from_components(empty, tables, inflows=inflows)
    m = m.but(entity=m.entity.cache(), attr=m.attr.cache(), rel=m.rel.cache())
    assert counts(m) == {"ElectricalBus": 4, "StorageUnit": 1, "HydraulicStorageUnit": 2, "HydroGenerationUnit": 2, "HVDCLink": 1, "GenericConversionUnit": 1, "ConversionPort": 3, "Profile": 1, "Carrier": 6}
    assert value(m, "link.dc", "max_flow") == 5.0 and value(m, "link.dc", "variable_operating_cost") == 2.0 and value(m, "store.t", "energy_storage_capacity") == 9.0
    assert value(m, "store.wet", "annual_natural_inflow_energy") == 4.0 and value(m, "hydro.store.p", "hydro_machine_kind") == "reversible"
    rel = {(r["entity_id"], r["relation_id"]): r["target_id"] for r in m.rel.collect()}
    assert rel["port.converter.el.output2", "atNode"] == "node.w" and rel["port.converter.el.input", "belongsToUnit"] == "converter.el" and rel["converter.el", "referencePort"] == "port.converter.el.input"
    assert ("store.wet", "atNode") not in rel and rel["hydro.store.wet", "drawsFromHydraulicStorage"] == "store.wet" and rel["store.t", "atNode"] == "node.h"
    assert [value(m, f"port.converter.el.{k}", "flow_coefficient") for k in ("input", "output1", "output2")] == [-1.0, 0.7, 0.2]
    assert {(r["profile_id"], r["t"], r["value"]) for r in m.profile_value.collect()} == {("profile.inflow.store.wet", 0, 0.25), ("profile.inflow.store.wet", 1, 0.75)}
    gone = {(r["component"], r["name"], r["reason"]) for r in networks.left_out(empty, tables, inflows=inflows).collect()}
    assert gone == {("stores", "dry", "reservoir without inflow"), ("links", "x", "unknown bus"), ("links", "y", "unknown bus")}
    unknown = {(r["entity_class"], r["field_id"]): r["n"] for r in networks.component_parts(empty, tables, inflows=inflows).unknown(empty).collect()}
    assert unknown == {("HydraulicStorageUnit", "has_active_charging"): 1, ("HydraulicStorageUnit", "storesResource"): 2}


def test_regions_and_zones(spark, empty):
    codes = frame(spark, "NUTS_ID string, LEVL_CODE int, CNTR_CODE string, NAME_LATN string", ("EL", 0, "EL", "Ellada"), ("EL3", 1, "EL", "Attiki"), ("EL30", 2, "EL", "Attiki"), ("EL301", 3, "EL", None), ("X", 4, "EL", "x"))
    m = regions.regions(empty, codes)
    parents = {r["entity_id"]: r["target_id"] for r in m.rel.collect()}
    assert parents == {"region.nuts1.EL3": "region.country.GR", "region.nuts2.EL30": "region.nuts1.EL3", "region.nuts3.EL301": "region.nuts2.EL30"}
    assert value(m, "region.country.GR", "name") == "GR" and value(m, "region.nuts3.EL301", "long_name") == "EL301"
    zones = regions.market_zones(m, frame(spark, "code string, long_name string, countries array<string>", ("GR", "Greece", ["GR"]), ("UK", "Kingdom", ["GB"])))
    assert [(r["entity_id"], r["target_id"]) for r in zones.rel.where("relation_id = 'coversRegion'").collect()] == [("market_zone.GR", "region.country.GR")]


def test_default_types(spark):
    from pyspark.sql import functions as F

    from edgeloom.functions import classify

    types = {"wind": "T.Wind", "offwind_ac": "T.Offshore", "gas": "T.Gas"}
    rows = frame(spark, "a string, b string", ("offwind-ac", None), (None, "Offwind AC float"), ("odd", "natural gas"), ("odd", None), ("wind", "gas"))
    assert [r[0] for r in rows.select(classify.default_type([F.col("a"), F.col("b")], types)).collect()] == ["T.Offshore", "T.Offshore", "T.Gas", None, "T.Wind"]
