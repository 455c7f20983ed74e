import pytest
from pyspark.sql import functions as F

from edgeloom.operators import market, spatial

CAPACITY = "Variable string, Policy string, Year string, `Climate Year` string, Value string, Type string, Node string"


def test_installed_capacities(spark):
    rows = spark.createDataFrame(
        [
            ("Installed Capacity (MW)", "NT", "2030", "1995", "100", "Gas CCGT new", "CH00"),
            ("Installed Capacity (MW)", "NT", "2025", "1995", "70", "Gas CCGT new", "CH00"),
            ("Installed Capacity (MW)", "NT", "2025", "1995", "50,5", "Gas OCGT", "CH00"),
            ("Installed Capacity (MW)", "DE", "2030", "1995", "9", "Gas OCGT", "CH00"),
            ("Generation", "NT", "2030", "1995", "9", "Gas OCGT", "CH00"),
            ("Charging Capacity", "NT", "2030", "1995", "0", "Battery", "CH00"),
        ],
        CAPACITY,
    )
    found = market.installed_capacities(rows, "NT", 2030, 1995, F.when(F.col("Type").startswith("Gas"), "ThermalGenerationUnit"))
    assert [tuple(r) for r in found.collect()] == [("CH00", "ThermalGenerationUnit", 150.5)]


def test_demand_and_renewables(spark):
    rows = spark.createDataFrame([("A", "1", "3"), ("A", "1", "-3"), ("B", "2", None)], "Node string, `0` string, `1` string")
    annual, series = market.demand(rows, ["Node"], ["0", "1"])
    assert {r["Node"]: r["annual"] for r in annual.collect()} == {"A": 2.0, "B": 2.0}
    assert {r["profile_id"]: r["s"] for r in series.groupBy("profile_id").agg(F.sum("value").alias("s")).collect()} == {"A": -1.0, "B": -1.0}
    factors = spark.createDataFrame([("w", 0, 0.25), ("w", 1, 0.75)], "profile_id string, t int, value double")
    energy, shape = market.renewables(factors, spark.createDataFrame([("w", 100.0)], "profile_id string, capacity double"))
    assert energy.first()["annual"] == 100.0 and shape.count() == 2


def test_transfer_capacities(spark):
    rows = [("BASE", "2025", "A", "B", "100", "90"), ("BASE", "2030", "A", "B", "120", "95"), ("Increment", "2028", "A", "B", "30", "5"), ("Increment", "2040", "A", "B", "500", "500"), ("BASE", "2030", "B", "C", "7", "8")]
    found = market.transfer_capacities(spark.createDataFrame(rows, "TYPE string, YEAR string, FROM string, TO string, P12 string, P21 string"), 2030)
    assert sorted(tuple(r) for r in found.collect()) == [("A", "B", 150.0, 100.0), ("B", "C", 7.0, 8.0)]


def test_storage_energy_reports_what_is_missing(spark):
    have, missing = market.storage_energy(spark.createDataFrame([("r1",), ("r2",)], "id string"), spark.createDataFrame([("r1", 5.0), ("r9", 1.0)], "id string, energy double"))
    assert {r["id"]: r["energy"] for r in have.collect()} == {"r1": 5.0, "r2": None} and [r["id"] for r in missing.collect()] == ["r9"]


def test_points_in_regions(spark):
    square = lambda name, x, y: [(name, x + a, y + b, x + c, y + d) for a, b, c, d in ((0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 2), (0, 2, 0, 0))]
    edges = spark.createDataFrame([tuple([n, *map(float, e)]) for n, *e in square("one", 0, 46) + square("two", 2, 46)], "region string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([("a", 1.0, 47.0), ("b", 3.5, 46.5), ("c", 4.05, 47.0), ("d", 9.0, 47.0), ("e", -0.02, 46.0)], "id string, lon double, lat double")
    assert {r["id"]: r["region"] for r in spatial.located(points, edges).collect()} == {"a": "one", "b": "two", "c": "two", "d": None, "e": "one"}


@pytest.mark.parametrize("lon", [0.5, 1.5])
def test_ring_with_a_notch(spark, lon):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 0.5), (0.0, 2.0)]
    edges = [("r", *ring[k], *ring[(k + 1) % 5]) for k in range(5)]
    frame = spark.createDataFrame(edges, "region string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([("in", lon, 1.0), ("out", 1.0, 1.5)], "id string, lon double, lat double")
    assert [r["id"] for r in spatial.containing(points, frame).collect()] == ["in"]
