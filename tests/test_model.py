import pytest
from pyspark.sql import functions as F

from edgeloom.model import ATTRIBUTE, ENTITY, RELATION
from edgeloom.operators import etl, mutation, navigation, profiles, reports, rollup
from edgeloom.plans import validation
from edgeloom.plans.schema import Schema, empty_model
from edgeloom.sources import readers, writers

SOURCE = {
    "attributes": {
        "weight_kg": {"type": "decimal", "constraints": {"minimum": 0}},
        "colour": {"type": "string", "constraints": {"enum": ["red", "blue"]}},
        "code": {"type": "string", "constraints": {"pattern": "[a-z]+"}},
        "price": {"type": "decimal"},
        "offer": {"type": "string"},
    },
    "relations": {"partOf": {"target": "Widget"}, "hasTechnology": {"target": "Kind"}},
    "classes": {
        "Base": {"abstract": True},
        "Kind": {"parents": ["Base"], "attributes": ["weight_kg", "colour"]},
        "Widget": {
            "parents": ["Base"],
            "attributes": [{"id": "weight_kg", "required": True}, {"id": "colour", "default": "blue"}, "code", {"id": "price", "required": True, "belongsToGroup": ["sale"]}, {"id": "offer", "belongsToGroup": ["sale"]}],
            "relations": ["partOf", "hasTechnology"],
        },
        "Gadget": {"parents": ["Widget"]},
    },
}


def build(spark, entities, values=(), edges=(), source=SOURCE):
    m = empty_model(spark, Schema.composed([source]))
    of = {i: c for i, c in entities}
    number = lambda v: float(v) if v.replace(".", "").replace("-", "").isdigit() else None
    entity = [(c, i, i.startswith("lib"), k) for k, (i, c) in enumerate(entities)]
    attr = [(of.get(i), i, a, v, number(v), None, None, None) for i, a, v in values]
    rel = [(of.get(i), i, r, t, k) for k, (i, r, t) in enumerate(edges)]
    return m.but(entity=spark.createDataFrame(entity, ENTITY), attr=spark.createDataFrame(attr, ATTRIBUTE), rel=spark.createDataFrame(rel, RELATION))


@pytest.fixture(scope="module")
def widgets(spark):
    entities = [("a", "Widget"), ("b", "Gadget"), ("c", "Widget"), ("lib.k", "Kind"), ("lib.l", "Kind"), ("lib.m", "Kind")]
    values = [("a", "weight_kg", "-1"), ("a", "colour", "green"), ("a", "code", "A1"), ("b", "weight_kg", "x"), ("c", "offer", "yes"), ("lib.k", "weight_kg", "7")]
    edges = [("a", "partOf", "lib.k"), ("a", "partOf", "b"), ("b", "partOf", "nowhere"), ("c", "hasTechnology", "lib.k"), ("lib.k", "hasTechnology", "lib.l")]
    return build(spark, entities, values, edges)


def test_violations(widgets):
    found = {(r["entity_id"], r["field_id"], r["rule"]) for r in validation.validate(widgets).collect()}
    assert found == {
        ("a", "weight_kg", "minimum"), ("a", "colour", "enum"), ("a", "code", "pattern"), ("b", "weight_kg", "type"), ("b", "partOf", "dangling"),
        ("a", "partOf", "target_class"), ("c", "weight_kg", "required"), ("c", "price", "required"),
    }
    with pytest.raises(validation.ValidationError, match=r"\[a|\[b|\[c"):
        validation.raise_for(validation.validate(widgets))
    assert {r["field_id"] for r in validation.unknown_fields(widgets).collect()} == {"hasTechnology"}


def test_navigation(widgets):
    assert {r["entity_id"] for r in navigation.entities(widgets, "Widget", derived=True).collect()} == {"a", "b", "c"}
    assert {r["entity_id"]: r["targets"] for r in navigation.targets(widgets, "partOf").collect()} == {"a": ["lib.k", "b"], "b": ["nowhere"]}
    effective = {r["entity_id"]: r["value"] for r in navigation.effective_values(widgets, "weight_kg").collect()}
    assert (effective["c"], effective["a"], effective["lib.m"]) == ("7", "-1", None)
    assert {r["entity_id"]: r["value"] for r in navigation.effective_values(widgets, "colour").collect()}["c"] == "blue"
    scope = {r["entity_id"] for r in navigation.library_scope(widgets).collect()}
    assert scope == {"a", "b", "c", "lib.k", "lib.l"}
    assert navigation.library_scope(widgets, "none").count() == 3 and navigation.library_scope(widgets, "all").count() == 6


def test_writes(spark, widgets):
    new = spark.createDataFrame([("Widget", "a", False, 9), ("Widget", "z", False, 10)], ENTITY)
    m = mutation.add_entities(widgets, new)
    assert m.entity.count() == 7
    assert m.attr.where("entity_id = 'z'").first()["value_str"] == "blue"
    m = mutation.set_relations(m, spark.createDataFrame([("Widget", "a", "partOf", "c", 0)], RELATION))
    assert [r["target_id"] for r in m.rel.where("entity_id = 'a'").collect()] == ["c"]
    m = mutation.set_relations_if_allowed(m, spark.createDataFrame([("Widget", "c", "partOf", "missing", 0), ("Widget", "c", "owns", "a", 0)], RELATION))
    assert m.rel.where("entity_id = 'c' and relation_id <> 'hasTechnology'").count() == 0
    left = etl.pruned(m, spark.createDataFrame([("c",)], "entity_id string"))
    assert left.rel.where("target_id = 'c' or entity_id = 'c'").isEmpty() and left.entity.count() == 6
    with pytest.raises(ValueError, match="a, b"):
        mutation.import_library(widgets, widgets)
    assert mutation.import_library(widgets, widgets, conflict="skip").entity.count() == 6
    assert mutation.duplicate_ids(mutation.import_library(widgets, widgets, conflict="overwrite")).isEmpty()
    named = mutation.import_library(widgets, widgets, "ns")
    assert named.rel.where("entity_id = 'ns.a'").agg(F.collect_set("target_id")).first()[0].__len__() == 2


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_files_round_trip(spark, widgets, tmp_path):
    none = empty_model(spark, Schema.composed([SOURCE]))
    writers.write_json(widgets, f"{tmp_path}/m.json")
    writers.write_yaml(widgets, f"{tmp_path}/m.yaml", "1.0.0")
    writers.write_long_csv(widgets, f"{tmp_path}/long")
    back = [readers.read_json(none, f"{tmp_path}/m.json"), readers.read_yaml(none, f"{tmp_path}/m.yaml"), readers.read_long_csv(none, f"{tmp_path}/long")]
    for m in back:
        assert rows(m.attr.select("entity_id", "attribute_id", "value_str")) == rows(widgets.attr.select("entity_id", "attribute_id", "value_str"))
        assert rows(m.rel.select("entity_id", "relation_id", "target_id")) == rows(widgets.rel.select("entity_id", "relation_id", "target_id"))
    writers.write_datapackage(widgets, Schema.composed([SOURCE]), f"{tmp_path}/pkg")
    m = readers.read_datapackage(none, f"{tmp_path}/pkg")
    assert m.entity.count() == 6 and m.rel.where("entity_id = 'a'").count() == 2
    values = spark.createDataFrame([("p", t, float(t)) for t in range(5)] + [("q", 1, 2.0)], "profile_id string, t int, value double")
    writers.write_parquet(widgets, values, f"{tmp_path}/parquet")
    m, series = readers.read_parquet_long(none, f"{tmp_path}/parquet")
    assert m.attr.count() == widgets.attr.count() and rows(series.where("profile_id = 'p'")) == rows(values.where("profile_id = 'p'"))
    writers.profiles_wide(values, ["p", "q"]).write.parquet(f"{tmp_path}/wide")
    assert rows(readers.read_profiles_wide(spark, f"{tmp_path}/wide").select("profile_id", "t", "value")) == rows(values)
    assert "Widget rdfs:subClassOf :Base" in writers.turtle(Schema.composed([SOURCE]), "http://x/")
    assert {r["view_class"] for r in writers.tidy_rows(widgets).collect()} == {None}


def test_matpower_matrices(spark, tmp_path):
    case = {"bus": [[1, 3, 90.5], [2, 1, 0]], "branch": [[1, 2, 0.01]]}
    (tmp_path / "c.m").write_text(writers.matpower_text(case) + "% mpc.gen = [ 9 ];\n")
    found = readers.read_matpower(spark, f"{tmp_path}/c.m").orderBy("matrix", "row").collect()
    assert [(r["matrix"], r["cells"]) for r in found] == [("branch", [1.0, 2.0, 0.01]), ("bus", [1.0, 3.0, 90.5]), ("bus", [2.0, 1.0, 0.0])]


def test_hourly_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Node ,Year,0,1\nA ,2030,1,x\nA,2030,2,4\n")
    table, keys, hours = readers.read_hourly_csv(spark, f"{tmp_path}/d.csv")
    assert keys == ["Node", "Year"] and hours == ["0", "1"]
    assert rows(profiles.grouped_hours(table, keys, hours)) == [("A", "2030", 0, 3.0), ("A", "2030", 1, 4.0)]


def test_profiles(spark):
    p = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0), ("b", 1, 2.0), ("z", 0, 0.0)], "profile_id string, t int, value double")
    assert rows(profiles.normalised(p).where("profile_id <> 'b'")) == [("a", 0, 0.25), ("a", 1, 0.75), ("z", 0, 0.0)]
    members = spark.createDataFrame([("g", "a", 100.0), ("g", "b", 300.0), ("g", "none", 50.0), ("g", "z", 0.0)], "group_id string, profile_id string, weight double")
    assert rows(profiles.combined(p, members)) == [("g", 0, 1.75), ("g", 1, 2.25)]
    weights = spark.createDataFrame([(0, 2.0)], "t int, weight double")
    assert {r["profile_id"]: r["annual"] for r in profiles.annual(p, weights).collect()} == {"a": 5.0, "b": 6.0, "z": 0.0}


BUS = "bus string, nuts3 string, kv double, lat double, lon double"


def test_rollup_conserves_totals(spark):
    buses = spark.createDataFrame([("ch021", "CH021", 380.0, 47.0, 8.0), ("ch022", "CH022", 380.0, None, 9.0), ("de111", "DE111", 380.0, 48.0, 9.0), ("de112", "DE112", 379.6, 49.0, 9.0), ("xx", None, 1.0, 0.0, 0.0)], BUS)
    mapped = rollup.bus_map(buses)
    assert {r["agg"] for r in rollup.rolled_buses(mapped).collect()} == {"node.ch.380", "node.de.380"}
    mixed = rollup.bus_map(buses, "disaggregated", {"DE": "country"})
    assert {r["agg"] for r in mixed.collect()} == {"ch021", "ch022", "node.de.380"}
    units = [("ch021", "gas.CCGT", 200.0), ("ch022", "gas.OCGT", 100.0), ("de111", "gas.CCGT", 300.0), ("de112", "gas.OCGT", 150.0)]
    columns = {"potential": 0.0, "pumping": 0.0, "efficiency": 0.5, "variable_cost": 1.0, "pumping_efficiency": None}
    gas = spark.createDataFrame(units, "bus string, tech string, capacity double").withColumn("bucket", F.lit("other"))
    gas = gas.withColumns({k: F.lit(v).cast("double") for k, v in columns.items()})
    rolled = rollup.rolled_generation(rollup.member(gas, mapped, F.col("tech")))
    assert sorted((r["id"], r["capacity"]) for r in rolled.collect()) == [("gen.gas.ccgt.agg.ch.380", 200.0), ("gen.gas.ccgt.agg.de.380", 300.0), ("gen.gas.ocgt.agg.ch.380", 100.0), ("gen.gas.ocgt.agg.de.380", 150.0)]
    one = rollup.rolled_generation(rollup.member(gas, mapped, F.col("tech"), {"gas": ["gas"]}))
    assert sorted((r["id"], r["capacity"], r["efficiency"]) for r in one.collect()) == [("gen.gas.agg.ch.380", 300.0, 0.5), ("gen.gas.agg.de.380", 450.0, 0.5)]
    before = gas.join(mapped, "bus").select("country", F.col("capacity").alias("v"))
    assert all(r["ok"] for r in reports.conservation(before, one.select("country", F.col("capacity").alias("v")), ["country"], "v").collect())
    branches = spark.createDataFrame([("l1", "ch021", "ch022", 1, 1), ("l2", "ch021", "de111", 1, 1), ("l3", "ch021", "de112", 0, 1), ("l4", "ch021", "xx", 1, 1)], "id string, from_bus string, to_bus string, from_on int, to_on int")
    assert {r["id"]: r["dropped"] for r in rollup.remapped_branches(branches, mapped).collect()} == {"l1": "internal", "l2": None, "l3": "switched_off", "l4": "outside"}


def test_rolled_profiles(spark):
    p = spark.createDataFrame([("a", t, v) for t, v in enumerate((0.1, 0.2, 0.3, 0.4))] + [("b", t, v) for t, v in enumerate((0.5, 0.6, 0.7, 0.8))], "profile_id string, t int, value double")
    members = spark.createDataFrame([("g", "a", 0.0, 100.0), ("g", "b", 0.0, 120.0), ("h", "a", 3.0, 100.0), ("h", "b", 1.0, 120.0)], "group_id string, profile_id string, potential double, capacity double")
    found = {(r["profile_id"], r["t"]): (r["kind"], r["value"]) for r in rollup.rolled_profiles(p, members).collect()}
    assert found["g", 0] == ("as_capacity_factor", pytest.approx((100 * 0.1 + 120 * 0.5) / 220))
    assert sum(v for (g, _), (_, v) in found.items() if g == "h") == pytest.approx(1.0)


def test_pipeline_steps(spark):
    t = spark.createDataFrame([("x", 2020, 1), ("x", 2030, 2), ("y", 2035, 3), (None, 2025, 4), ("z", None, 5)], "k string, y int, v int")
    assert sorted(r["v"] for r in etl.carry_forward(t, ["k"], "y", 2030).collect()) == [2, 3, 4]
    numbered = etl.assigned_numbers(spark.createDataFrame([("g", "bus.7", None), ("g", "bus.x", None), ("g", "old.7", None), ("g", "set", 3)], "part string, id string, n long"), "id", F.col("n"))
    assert {r["id"]: r["number"] for r in numbered.collect()} == {"bus.7": 7, "bus.x": 8, "old.7": 9, "set": 3}
    links = spark.createDataFrame([("l", "AC", "AC", "a", "b", None, None), ("m", "gas", "AC", "a", "b", "c", "")], "link string, carrier0 string, carrier1 string, bus0 string, bus1 string, bus2 string, bus3 string")
    same, units = etl.links_split(links)
    assert [r["link"] for r in same.collect()] == ["l"] and units.count() == 3
    value = reports.dominant(spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4)], "k string, v string, s int"), ["k"], "v", "s").first()
    assert value["v"] == "b"
    average = spark.createDataFrame([(1.0, 2.0), (5.0, 0.0), (None, 3.0), (4.0, 1.0)], "v double, w double").agg(reports.weighted_average(F.col("v"), F.col("w"))).first()[0]
    assert average == 2.0


def test_analysis_profile(spark, tmp_path, widgets):
    (tmp_path / "p.yaml").write_text("name: p\nrequirements:\n- entity_class: Widget\n  checks:\n  - {attribute: weight_kg, constraints: {minimum: 5}}\n  - {attribute: code, when: offer, required: true}\n")
    found = validation.validate_for_analysis(widgets, validation.load_profile(str(tmp_path)))
    assert {(r["entity_id"], r["field_id"], r["rule"]) for r in found.collect()} == {("a", "weight_kg", "minimum"), ("c", "code", "required")}
    assert validation.validate_for_analysis(widgets, {}).isEmpty()
