"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from edgeloom import catalog
from edgeloom.streaming import events

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {name} as from '{DATA}/{name}.parquet'")
    return con


def plain(x):
    return repr(round(float(x), 6) + 0.0) if type(x).__name__ in ("float", "Decimal") else str(x)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, db, name):
    frame = catalog.QUERIES[name](spark, DATA)
    cursor = db.execute(catalog.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    wanted = sorted([[plain(v) for _, v in sorted(zip(columns, r, strict=True))] for r in cursor.fetchall()])
    assert sorted([[plain(r[c]) for c in sorted(frame.columns)] for r in frame.collect()]) == wanted


def test_all_queries_have_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_stream_counts_equal_the_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.tumbling(events.event_stream(spark, f"{tmp_path}/in"), "1 day", "40 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", f"{tmp_path}/c").start()
    run.processAllAvailable()
    run.stop()
    order = ["window_start", "event_type"]
    assert spark.table("counted").orderBy(*order).collect() == events.tumbling(batch, "1 day").orderBy(*order).collect()


def test_running_totals_of_a_stream(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet").where("user_id < 5")
    batch.repartition(2).write.parquet(f"{tmp_path}/in")
    run = events.running_totals(events.event_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", f"{tmp_path}/c").start()
    run.processAllAvailable()
    run.stop()
    last = {r["user_id"]: r["n"] for r in spark.sql("select user_id, max(n) as n from totals group by 1").collect()}
    assert last == {r["user_id"]: r["count"] for r in batch.groupBy("user_id").count().collect()}
