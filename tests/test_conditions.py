import pytest

from edgeloom.plans.conditions import ConditionError, Fields, compiled, when

ROWS = [("a", 5.0, "red", True, ["x"]), ("b", None, "", None, None), ("c", 0.0, "blue", False, [])]
SCHEMA = "id string, p double, colour string, flag boolean, link array<string>"


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows, Fields(dict(rows.dtypes), frozenset({"link"}))


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("p", "ac"),
        ("not p", "b"),
        ("p > 0", "a"),
        ("p >= 0", "ac"),
        ("p != 5", "c"),
        ("p == -1", ""),
        ("colour", "ac"),
        ("colour == 'red'", "a"),
        ("colour != 'red'", "bc"),
        ("colour == 3", ""),
        ("flag == True", "a"),
        ("flag", "ac"),
        ("link", "a"),
        ("not link and p == 0", "c"),
        ("(p > 4 or colour == 'blue') and not unknown", "ac"),
        ("unknown", ""),
        ("unknown == 1", ""),
        ("p < 'x'", ""),
        ("1 < 2", "abc"),
        ("4 < p", "a"),
        ("5 == p", "a"),
        ("p == p", "ac"),
        ("p > -p", "a"),
        ("p == unknown", ""),
        ("p != unknown", "ac"),
        ("colour == p", ""),
        ("colour != p", "abc"),
        ("'blue' == colour", "c"),
        ("None == p", ""),
        ("True", "abc"),
    ],
)
def test_strings(table, text, ids):
    rows, fields = table
    assert "".join(sorted(r["id"] for r in rows.where(compiled(text, fields)).collect())) == ids


@pytest.mark.parametrize("text", ["f(p)", "p.x", "0 < p < 5", "link == 'x'", "p +", "p + 1 > 2", "p in [1]"])
def test_not_allowed(table, text):
    with pytest.raises(ConditionError):
        compiled(text, table[1])


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        (None, "abc"),
        ({"attribute_set": "p"}, "ac"),
        ({"attribute_unset": "p"}, "b"),
        ({"relation_set": "link"}, "a"),
        ({"relation_unset": "link"}, "bc"),
        ({"attribute_equals": {"attribute": "colour", "value": "red"}}, "a"),
        ({"attribute_compare": {"attribute": "p", "op": ">=", "value": 0}}, "ac"),
        ([{"attribute_set": "p"}, {"relation_set": "link"}], "a"),
        ({"attribute_compare": {"attribute": "p", "op": "~", "value": 0}}, ""),
        ({"what": "p"}, ""),
        ({}, ""),
    ],
)
def test_mappings(table, condition, ids):
    rows, fields = table
    assert "".join(sorted(r["id"] for r in rows.where(when(condition, fields)).collect())) == ids
