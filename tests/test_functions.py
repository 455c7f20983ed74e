import pytest
from pyspark.sql import functions as F

from edgeloom.functions import classify, numbers, text


def value(spark, column, **inputs):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items())).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.slugify, "Big - Plant (North)", "big_plant_north"),
        (text.slug_name, "--A b/C.d!", "a-b/c.d"),
        (text.kebab, "AllEntitiesHTML5Table", "all-entities-html5-table"),
        (text.id_tag, "  Hydro / Run-of-River ", "hydro.run.of.river"),
        (text.id_tag, " -- ", "unknown"),
        (text.underscored, "Ab  c-D", "ab_c_d"),
        (text.normalize_code, "NUTS3.CH021", "ch021"),
        (numbers.to_double, " 1,5 ", 1.5),
        (numbers.to_double, "x", None),
        (numbers.safe_double, "NaN", None),
        (numbers.to_long, "3.9", 3),
        (numbers.to_bool, " Yes ", True),
        (numbers.to_bool, "t", None),
        (numbers.generation_category, "WindUnit offshore", "wind_offshore"),
        (numbers.generation_category, "thermal gas", None),
    ],
)
def test_one_value(spark, f, given, wanted):
    assert value(spark, f(F.col("x")), x=given) == wanted


@pytest.mark.parametrize(("level", "wanted"), [("country", "CH"), ("nuts1", "CH0"), ("nuts2", "CH02"), ("nuts3", "CH021")])
def test_levels(spark, level, wanted):
    assert value(spark, text.nuts_level(F.col("x"), level), x="CH021") == wanted


@pytest.mark.parametrize(("pattern", "wanted"), [("wind", True), ("wind.*", True), ("WIND.on?hore", True), ("win", False), ("*.offshore", False), ("[vw]ind*", True), ("[!w]*", False)])
def test_globs(spark, pattern, wanted):
    assert value(spark, text.technology_matches(F.col("x"), pattern), x="wind.onshore") is wanted


def test_longest_pattern(spark):
    groups = {"any": ["wind"], "land": ["wind.on*"]}
    assert value(spark, text.longest_pattern(F.col("x"), groups), x="wind.onshore") == "land"
    assert value(spark, text.longest_pattern(F.col("x"), groups), x="solar") == "solar"


def test_targets_from_text(spark):
    for given, wanted in (('["a","b"]', ["a", "b"]), ("a; b;", ["a", "b"]), ("a,b", ["a", "b"]), ("a", ["a"])):
        assert value(spark, text.split_targets(F.col("x")), x=given) == wanted


def test_per_unit_round_trip(spark):
    r, x, b = numbers.to_per_unit(F.col("r"), F.col("x"), F.col("b"), F.lit(220.0), 100.0)
    r, x, b = numbers.from_per_unit(r, x, b, F.lit(220.0), 100.0)
    row = spark.range(1).select(F.lit(2.0).alias("r"), F.lit(20.0).alias("x"), F.lit(1e-5).alias("b")).select(r.alias("r"), x.alias("x"), b.alias("b")).first()
    assert tuple(row) == pytest.approx((2.0, 20.0, 1e-5))
    assert value(spark, numbers.nearest(F.col("x"), [380.0, 220.0, 110.0]), x=165.0) == 110.0
    assert value(spark, numbers.iso_duration(F.col("x")), x=900) == "PT15M"


@pytest.mark.parametrize(
    ("name", "pumped", "stored", "inflow", "machine"),
    [
        ("PHS Closed/Loop", True, True, False, "reversible"),
        ("phs.closed-loop", True, True, False, "reversible"),
        ("Pondage", False, True, True, "turbine"),
        ("dam_ror", False, False, True, "turbine"),
        ("hydro.pump", False, False, False, "pump"),
        ("pump", False, False, False, "pump"),
        ("pump house", False, False, False, "turbine"),
        (None, False, False, False, "turbine"),
        ("", False, False, False, "turbine"),
    ],
)
def test_facts_of_technologies(spark, name, pumped, stored, inflow, machine):
    c = F.col("x").cast("string")
    assert [value(spark, classify.fact(f, c), x=name) for f in ("pumped", "stored", "natural_inflow")] == [pumped, stored, inflow]
    assert value(spark, classify.machine_kind(c), x=name) == machine


@pytest.mark.parametrize(("flag", "pumping", "generation", "wanted"), [(True, None, None, "reversible"), (None, 5.0, 5.0, "reversible"), (None, 5.0, 0.0, "pump"), (False, 0.0, 5.0, "turbine"), (None, None, None, "turbine")])
def test_machines_by_their_powers(spark, flag, pumping, generation, wanted):
    given = {"f": flag, "p": pumping, "g": generation}
    found = classify.machine_kind(F.lit("francis"), F.col("f").cast("boolean"), F.col("p").cast("double"), F.col("g").cast("double"))
    assert value(spark, found, **given) == wanted


@pytest.mark.parametrize(("raw", "technology", "wanted"), [("inf", "h2 fuel cell", 0.55), ("-1", "h2_ccgt", 0.58), (None, "hydrogen", 1.0), ("0.4", "hydrogen ccgt", 0.4), ("x", "gas ccgt", 1.0)])
def test_efficiencies(spark, raw, technology, wanted):
    assert value(spark, classify.efficiency(F.lit(None), F.col("t"), F.col("r").cast("string")), r=raw, t=technology) == wanted


def test_names_of_merged_assets(spark):
    token = lambda bus, split, same: tuple(value(spark, c, bus=bus) for c in classify.asset_region_key(F.col("bus"), split, F.lit(same)))
    assert token("node.ch.380", True, False) == ("ch", ".380") and token("node.ch.380", False, False) == ("ch", "")
    assert token("node.ch.380", True, True) == ("ch.380", "") and token("Bus 7", True, False) == ("bus.7", "")


def test_impedance_of_a_transformer(spark):
    r, x = numbers.transformer_impedance(F.col("vk"), F.col("vkr"), F.lit(50.0), 100.0)
    assert (value(spark, r, vk=10.0, vkr=6.0), value(spark, x, vk=10.0, vkr=6.0)) == pytest.approx((0.12, 0.16))
