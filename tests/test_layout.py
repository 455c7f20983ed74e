import re

import pytest
from pyspark.sql import functions as F

from edgeloom import catalog
from edgeloom.plans import validation
from edgeloom.sources import layout, star

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scans(df):
    return len(set(re.findall(r"^\((\d+)\) Scan parquet", plan(df), re.M)))


@pytest.mark.parametrize(("plain", "kept"), [(star.star_rows, star.star_model), (star.energy_rows, star.energy_model)])
def test_layout_keeps_every_row(spark, plain, kept, tmp_path):
    a, b = plain(spark, DATA), kept(spark, DATA)
    layout.write_stored(a, f"{tmp_path}/m")
    c = layout.read_stored(spark, f"{tmp_path}/m")
    for name in (*layout.TABLES, *layout.SCHEMA_TABLES):
        x, y, z = (getattr(m, name) for m in (a, b, c))
        assert x.columns == y.columns == z.columns
        assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty() and x.exceptAll(z).isEmpty() and z.count() == x.count()


def test_filters_reach_folders_and_files(spark):
    m = star.energy_model(spark, DATA)
    text = plan(m.attr.where((F.col("entity_class") == "DemandUnit") & (F.col("attribute_id") == "annual_energy_demand")).select("entity_id"))
    assert re.search(r"PartitionFilters: \[.*entity_class.*DemandUnit", text) and "EqualTo(attribute_id,annual_energy_demand)" in text
    text = plan(validation.out_of_range(star.star_model(spark, DATA)))
    assert re.search(r"PartitionFilters: \[.*entity_class.*IN", text) and "In(attribute_id" in text and scans(validation.out_of_range(star.star_model(spark, DATA))) == 1


@pytest.mark.parametrize(("name", "most"), [("totals_of_twelve_categories", 35), ("validate_linked", 22), ("subset_of_buses", 13), ("library_closure", 33), ("validate_minimum", 1)])
def test_plans_read_each_table_a_few_times(spark, name, most):
    assert scans(catalog.QUERIES[name](spark, DATA)) <= most


def test_changed_input_is_written_again(spark, tmp_path):
    for n in ("region", "nation", "supplier", "customer", "part"):
        spark.read.parquet(f"{DATA}/{n}.parquet").write.parquet(f"{tmp_path}/{n}.parquet")
    before = star.star_model(spark, str(tmp_path)).entity.count()
    assert star.star_model(spark, str(tmp_path)) is star.star_model(spark, str(tmp_path))
    spark.read.parquet(f"{DATA}/supplier.parquet").limit(3).write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    suppliers = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert star.star_model(spark, str(tmp_path)).entity.count() == before - suppliers + 3
