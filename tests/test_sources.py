"""Files there and back, with relations and load order; what a package, a schema and the command line say."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from edgeloom import check
from edgeloom.operators import market, mutation, navigation, profiles
from edgeloom.plans import schema as schemas
from edgeloom.plans import validation
from edgeloom.plans.schema import Schema, empty_model
from edgeloom.sources import hierarchical, readers, writers
from edgeloom.sources.star import ENERGY_SCHEMA, energy_model
from edgeloom.streaming import events

DATA = "/root/testdata/sf0.001"
SCHEMA = Schema.composed([ENERGY_SCHEMA])


@pytest.fixture(scope="module")
def model(spark):
    """A part of the energy model that is read often."""
    m = energy_model(spark, DATA)
    keep = m.entity.where("entity_class IN ('ElectricalBus', 'GenerationUnit', 'HydroGenerationUnit', 'GenerationResult', 'PeakResult', 'GeographicalRegion', 'Profile')")
    cut = lambda t: t.join(keep.select("entity_id"), "entity_id", "left_semi").select(*t.columns).cache()
    return m.but(entity=cut(m.entity), attr=cut(m.attr), rel=cut(m.rel))


@pytest.fixture(scope="module")
def empty(spark):
    return empty_model(spark, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(found, wanted):
    assert rows(found.entity.select("entity_class", "entity_id")) == rows(wanted.entity.select("entity_class", "entity_id"))
    assert rows(found.attr.select("entity_id", "attribute_id", F.coalesce(F.col("value_num").cast("string"), "value_str"))) == rows(wanted.attr.select("entity_id", "attribute_id", F.coalesce(F.col("value_num").cast("string"), "value_str")))
    assert rows(found.rel.select("entity_id", "relation_id", "target_id", "ord")) == rows(wanted.rel.select("entity_id", "relation_id", "target_id", "ord"))


def test_parquet_keeps_relations_in_order(spark, model, empty, tmp_path):
    more = model.rel.limit(1).select("entity_class", "entity_id", F.lit("hasOutputCarrier").alias("relation_id"), F.explode(F.array(F.lit("z"), F.lit("a"))).alias("target_id")).withColumn("ord", F.when(F.col("target_id") == "z", 0).otherwise(1))
    m = model.but(rel=model.rel.unionByName(more))
    writers.write_parquet(m, model.profile_value, f"{tmp_path}/p")
    back, series = readers.read_parquet_long(empty, f"{tmp_path}/p")
    same(back, m)
    assert rows(series) == rows(model.profile_value)


def test_narrow_files_there_and_back(model, empty, tmp_path):
    writers.write_csv_by_class_with_schema(model, SCHEMA, f"{tmp_path}/n")
    same(readers.read_narrow_csv(empty, f"{tmp_path}/n"), model)
    described = json.loads((tmp_path / "n" / "GenerationUnit.schema.json").read_text())
    assert described["class"] == "GenerationUnit" and {f["name"] for f in described["columns"]} >= {"entity_id", "atNode", "nominal_power_capacity"}
    writers.write_long_csv_with_schema(model, f"{tmp_path}/long")
    assert len(json.loads((tmp_path / "long" / "long.schema.json").read_text())["fields"]) == 8


def test_hierarchical_yaml_there_and_back(model, empty, tmp_path):
    path = f"{tmp_path}/h.yaml"
    writers_view = model.but(entity=model.entity.where("entity_class <> 'PeakResult'"), attr=model.attr.where("entity_class <> 'PeakResult'"), rel=model.rel.where("entity_class <> 'PeakResult'"))
    hierarchical.write_hierarchical_yaml(writers_view, path, version="2.1.0")
    body = yaml.safe_load(open(path))
    assert body["_meta"] == {"schema_version": "2.1.0"} and "GenerationResult" not in body
    assert body["GenerationUnit"]["gen.8"]["representations"]["GenerationResult"]["attributes"]["core"]["total_generation"]
    back = hierarchical.read_hierarchical_yaml(empty, path, version="2.0.0")
    renamed = lambda t, *cs: t.withColumns({c: F.when(F.col(c).startswith("result."), F.concat(F.lit("generation_result.gen."), F.regexp_extract(c, r"(\d+)", 1))).otherwise(F.col(c)) for c in cs})
    same(back, writers_view.but(entity=renamed(writers_view.entity, "entity_id"), attr=renamed(writers_view.attr, "entity_id"), rel=renamed(writers_view.rel, "entity_id", "target_id")))
    with pytest.warns(UserWarning, match="2.1.0"):
        hierarchical.read_hierarchical_yaml(empty, path, version="3.0.0")


def test_yaml_forms_of_fields(empty, tmp_path):
    body = {
        "ElectricalBus": {"b": {"attributes": {"name": "Bus"}}},
        "GenerationUnit": [{"id": "g", "attributes": [{"id": "nominal_power_capacity", "value": 3, "unit": "MW"}], "relations": [{"id": "atNode", "target_entity_ids": ["b"]}]}, {"id": "h", "attributes": {"core": {"name": {"value": "H"}}, "more": {"name": {"value": "H"}}}, "relations": {"atNode": "b"}}],
        "Profile": None,
    }
    (tmp_path / "f.yaml").write_text(yaml.safe_dump(body))
    m = hierarchical.read_hierarchical_yaml(empty, f"{tmp_path}/f.yaml")
    assert rows(m.attr.select("entity_id", "attribute_id", "value_str", "unit")) == [("b", "name", "Bus", None), ("g", "nominal_power_capacity", "3", "MW"), ("h", "name", "H", None)]
    assert rows(m.rel.select("entity_id", "target_id")) == [("g", "b"), ("h", "b")]
    assert [r["entity_id"] for r in m.entity.orderBy("seq").collect()] == ["b", "g", "h"]


def test_load_order_is_that_of_the_files(spark, empty, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "GenerationUnit.csv").write_text("entity_id,attribute,value,relation\n" + "".join(f"g{k},name,n{k},\n" for k in (5, 3, 9, 1)))
    (tmp_path / "f" / "ElectricalBus.csv").write_text("entity_id,attribute,value,relation\nb,__exists__,,\n")
    m = readers.read_narrow_csv(empty, f"{tmp_path}/f")
    assert [r["entity_id"] for r in m.entity.orderBy("seq").collect()] == ["b", "g5", "g3", "g9", "g1"]
    assert rows(m.entity.select("entity_id", "seq")) == rows(m.entity.select("entity_id", "seq"))


def test_packages_have_union_tables_and_keys(spark, model, empty, tmp_path):
    writers.write_datapackage(model, SCHEMA, f"{tmp_path}/pkg")
    described = {r["title"]: r for r in json.loads((tmp_path / "pkg" / "datapackage.json").read_text())["resources"]}
    assert {"AllEntities", "AllNetworkNode", "GenerationUnit"} <= set(described)
    keys = {k["fields"][0]: k["reference"]["resource"] for k in described["GenerationUnit"]["schema"]["foreignKeys"]}
    assert keys["atNode"] == described["AllNetworkNode"]["name"] and keys["hasAvailabilityProfile"] == described["Profile"]["name"] and keys["hasTechnology"] == described["AllEntities"]["name"]
    assert spark.read.csv(f"{tmp_path}/pkg/AllEntities.csv", header=True).count() == model.entity.count()
    same(readers.read_any(empty, f"{tmp_path}/pkg"), model)
    with pytest.raises(ValueError, match="no reader"):
        readers.read_any(empty, f"{tmp_path}/x.xlsx")


def test_json_of_every_class(spark, model, empty, tmp_path):
    writers.write_json(model, f"{tmp_path}/m.json")
    m = readers.read_any(empty, f"{tmp_path}/m.json")
    assert rows(m.attr.select("entity_id", "attribute_id")) == rows(model.attr.select("entity_id", "attribute_id"))
    writers.write_json_lines(model, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines").count() == m.entity.count()
    none = model.but(**{t: getattr(model, t).limit(0) for t in ("entity", "attr", "rel")})
    writers.write_json(none, f"{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == {}


def test_row_types_with_checks(spark):
    kind, checks = schemas.struct_type(SCHEMA, "GenerationUnit")
    assert dict((f.name, f.dataType.simpleString()) for f in kind)["nominal_power_capacity"] == "double"
    data = [{"entity_id": "a", "nominal_power_capacity": 1.0, "dispatch_type": "dispatchable"}, {"entity_id": "b", "nominal_power_capacity": -1.0, "dispatch_type": None}, {"entity_id": "c", "nominal_power_capacity": None, "dispatch_type": "other"}]
    t = spark.createDataFrame(data, kind)
    assert [r["entity_id"] for r in t.where(" AND ".join(f"({c})" for c in checks.values())).collect()] == ["a"]


def test_names_manifests_and_text_of_a_schema(tmp_path):
    assert schemas.canonical_class("generation-unit", ["Generation_Unit", "X"]) == "Generation_Unit" and schemas.canonical_class("y", ["X"]) is None
    (tmp_path / "manifest.yaml").write_text("name: s\nversion: 1.2.0\nstability:\n  stable: [A]\n  B: experimental\n")
    manifest = schemas.read_manifest(str(tmp_path))
    assert [schemas.stability(manifest, n) for n in "ABC"] == ["stable", "experimental", "unknown"]
    assert schemas.read_manifest(str(tmp_path / "none")) == {}
    text = writers.turtle(SCHEMA, "http://x/")
    assert "rdfs:range xsd:decimal" in text and "unit: MW" in text and ":atNode a owl:ObjectProperty" in text


def test_command_line(spark, model, tmp_path, capsys):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s.yaml").write_text(yaml.safe_dump(ENERGY_SCHEMA))
    (tmp_path / "p.yaml").write_text(yaml.safe_dump({"name": "p", "requirements": [{"entity_class": "GenerationUnit", "checks": [{"attribute": "gain", "view_family": "avr"}]}]}))
    (tmp_path / "q.yaml").write_text(yaml.safe_dump({"name": "q", "requirements": [{"entity_class": "ElectricalBus", "checks": [{"attribute": "name"}]}]}))
    hierarchical.write_hierarchical_yaml(model, f"{tmp_path}/m.yaml")
    run = lambda *a: check.main([f"{tmp_path}/m.yaml", "--schema", f"{tmp_path}/s", *a], spark)
    assert run("--profile", f"{tmp_path}/q.yaml") == 0 and "nothing found" in capsys.readouterr().out
    assert run("--profile", f"{tmp_path}/p.yaml", "--profile", f"{tmp_path}/q.yaml", "--json") == 1
    out = json.loads(capsys.readouterr().out)
    assert out["q"] == [] and {r["rule"] for r in out["p"]} == {"unresolved", "required"}
    assert check.main([f"{tmp_path}/none.yaml", "--schema", f"{tmp_path}/s"], spark) == 2


def test_links_and_legacy_forms(spark, model):
    t = spark.createDataFrame([("gen.1", "node.x", None), ("gen.2", None, "profile.9"), ("lost", "node.y", None)], "entity_id string, bus string, profile string")
    m = mutation.linked(model, t, atNode="bus", hasAvailabilityProfile="profile")
    at = {r["entity_id"]: r["node"] for r in navigation.asset_nodes(m).collect()}
    assert at["gen.1"] == "node.x" and "lost" not in at and at["gen.2"].startswith("node.")
    assert {r["entity_id"]: r["profile"] for r in navigation.profile_links(m).collect()}["gen.2"] == "profile.9"
    ports = spark.createDataFrame([("Port", "p1", "is_reference_port", "true", None, True, None, None), ("Port", "p2", "is_reference_port", "false", None, False, None, None)], m.attr.schema)
    units = spark.createDataFrame([("Port", "p1", "belongsToUnit", "gen.1", 0), ("Port", "p2", "belongsToUnit", "gen.1", 0)], m.rel.schema)
    new = mutation.without_legacy(m.but(attr=m.attr.unionByName(ports), rel=m.rel.unionByName(units)))
    assert [(r["entity_id"], r["target_id"]) for r in new.rel.where("relation_id = 'hasReferencePort'").collect()] == [("gen.1", "p1")]
    assert new.attr.where("attribute_id = 'is_reference_port'").isEmpty()


def test_dangling_targets_of_a_built_in_library(spark, model):
    lost = validation.dangling(model)
    assert {r["detail"][:5] for r in lost.collect()} >= {"res.1"} or not lost.isEmpty()
    known = lost.select(F.col("detail").alias("entity_id"))
    assert validation.dangling(model, known).isEmpty()


def test_market_tables_and_made_up_series(spark):
    t = spark.createDataFrame([("p", "2009", "AT00", "Electrolyser", "Installed", "2030", "5,5"), ("p", "2009", "AT00", "Electrolyser", "Installed", "2025", "9"), ("p", "2009", "AT00", "Heat pump", "Installed", "2030", "-2"), ("p", "2009", " BE00", "Gas", "Installed", "2030", "7"), ("q", "2009", "AT00", "Electrolyser", "Installed", "2030", "1")], "Policy string, `Climate Year` string, Node string, Type string, Variable string, Year string, Value string")
    nodes, countries = market.nodes_and_countries(t)
    assert rows(nodes) == [("AT00", "AT"), ("BE00", "BE")] and rows(countries) == [("AT",), ("BE",)]
    assert rows(market.conversion_demand(t, "p", 2030, 2009, ("electroly", "heat pump"))) == [("AT00", 7.5)]
    for kind in ("solar", "wind", "demand", "decay"):
        low, high, n = profiles.synthetic(spark, kind, 200).agg(F.min("value"), F.max("value"), F.count("*")).first()
        assert n == 200 and -1e-9 <= low < high <= 1.4


def test_counters_that_fill_as_rows_are_written(spark, tmp_path):
    t, seen = events.observed(spark.range(10), "n", rows=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    t.write.parquet(f"{tmp_path}/t")
    assert seen.get == {"rows": 10, "odd": 5}
