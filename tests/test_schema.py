import pytest

from edgeloom.plans.schema import Schema, SchemaError, cardinality, compatible, merged_registry

BASE = {
    "units": {"MW": {}},
    "attributes": {"name": {"type": "string"}, "mass": {"value": {"type": "decimal", "constraints": {"minimum": 0}}, "unit": {"constraints": {"enum": ["MW"]}}}, "colour": {"type": "string", "constraints": {"enum": ["red", "blue"]}}},
    "relations": {"partOf": {"target": "Thing", "cardinality": "0..*"}, "reportsOn": {"target": "EnergyAssetInstance"}},
    "classes": {
        "Thing": {"attributes": ["name"]},
        "Left": {"parents": ["Thing"], "abstract": True, "view_family": "flow", "attributes": [{"id": "name", "default": "left"}]},
        "Right": {"parents": ["Thing"], "attributes": [{"id": "name", "default": "right"}, "colour"]},
        "Both": {"parents": ["Left", "Right"], "relations": ["partOf"]},
        "EnergyAssetInstance": {"parents": ["Thing"]},
        "Unit": {"parents": ["EnergyAssetInstance"], "attributes": ["mass"]},
        "Wind": {"parents": ["Unit"]},
        "Report": {"parents": ["Thing"], "relations": ["reportsOn"]},
    },
}


def test_inheritance(spark):
    s = Schema.composed([BASE])
    assert s.fields("Both")["attribute", "name"]["default"] == "left"  # the first parent wins
    assert s.ancestors("Both") == {"Both": 0, "Left": 1, "Right": 1, "Thing": 2}
    assert (s.view_family("Both"), s.role("Wind"), s.role("Report"), s.role("Right"), s.top_family("Wind")) == ("flow", "asset", "view", "domain", "Unit")
    class_def, closure, field = s.frames(spark)
    assert {r["class_name"]: r["abstract"] for r in class_def.collect()}["Both"] is False
    assert closure.where("class_name = 'Wind'").count() == 4
    mass = field.where("class_name = 'Wind' and field_id = 'mass'").first()
    assert (mass["minimum"], mass["units"], mass["dtype"]) == (0.0, ["MW"], "decimal")


@pytest.mark.parametrize(
    "classes",
    [{"A": {"parents": ["B"]}, "B": {"parents": ["A"]}}, {"A": {"parents": ["Nowhere"]}}, {"A": {"attributes": ["no_such"]}}],
)
def test_broken_schemas(classes):
    with pytest.raises(SchemaError):
        Schema.composed([{"classes": classes}])


def test_augmentation_and_conflicts():
    more = {"attributes": {"extra": {"type": "string"}}, "augmentations": {"Right": {"attributes": ["extra"]}}}
    assert ("attribute", "extra") in Schema.composed([BASE, more]).fields("Both")
    with pytest.raises(SchemaError, match="Right"):
        Schema.composed([BASE, {"augmentations": {"Rihgt": {}}}])
    with pytest.raises(SchemaError):
        merged_registry([{"a": {"type": "string"}}, {"a": {"type": "decimal"}}], "attributes")
    with pytest.raises(SchemaError, match="kW"):
        Schema.composed([{"units": {"MW": {}}, "attributes": {"p": {"unit": "kW"}}, "classes": {}}])


def test_json_schema_and_small_helpers():
    defs = Schema.composed([BASE]).json_schema()["$defs"]
    assert defs["Both"]["properties"]["partOf"] == {"type": "array", "items": {"type": "string"}, "minItems": 0}
    assert defs["Unit"]["properties"]["mass"] == {"type": "number", "minimum": 0.0}
    assert (cardinality("1"), cardinality("0..1"), cardinality("1..*")) == ((1, 1), (0, 1), (1, None))
    assert compatible("2.1.0", "2.0.9") and not compatible("3.0.0", "2.1.0") and not compatible("2.0.0", "2.1.0")
    assert Schema.composed([{"classes": {"A": {"relations": [{"id": "r", "target": "Z", "cardinality": "1"}]}}}]).dangling_targets() == [("A", "r", "Z")]
