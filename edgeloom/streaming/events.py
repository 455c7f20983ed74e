"""Event streams: windowed counts with watermarks, sessions, and a running state for each user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import NumericType

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; events later than `late` are left out of a stream (a batch has none)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n and total so far, after each batch in which the user has events."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


#: Rows in a block of time, about, and blocks at most: a key with a large share of all rows has that share of each.
BLOCK_ROWS, BLOCKS = 1_000_000, 512


def time_block(rows: DataFrame, time: str, blocks: int | None = None) -> Column:
    """The number of the block of time that a row lies in: blocks of about as many rows each, in order of time."""
    blocks = blocks or max(1, min(BLOCKS, -(-rows.count() // BLOCK_ROWS)))
    at = F.col(time).cast("double") if isinstance(rows.schema[time].dataType, NumericType) else F.col(time).cast("timestamp").cast("double")
    cuts = rows.select(at.alias("at")).stat.approxQuantile("at", [k / blocks for k in range(1, blocks)], 0.2 / blocks) if blocks > 1 else []
    return F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<double>"), lambda c: c <= at))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, blocks: int | None = None) -> DataFrame:
    """Each left row with the value of the latest right row of its key up to its time.

    Inside a block of time a window finds it; a window over the last values of a key's blocks, of which there are few,
    carries it on to later ones. So no key's history is one task."""
    names = [c for c in left.columns if c not in (key, time)]
    kept = F.struct(*names) if names else F.lit(None)
    both = left.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1).alias("side"), kept.alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    both = both.unionByName(right.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col(value).alias("v")))
    both = both.withColumn("block", time_block(both, "t", blocks))
    inside = Window.partitionBy("k", "block").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = both.groupBy("k", "block").agg(F.max_by("v", F.when((F.col("side") == 0) & F.col("v").isNotNull(), F.col("t"))).alias("last"))
    carried = lasts.select(F.col("k").alias("ck"), F.col("block").alias("cb"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = both.withColumn("own", F.last("v", ignorenulls=True).over(inside)).where("side = 1")
    found = found.join(carried, F.col("k").eqNullSafe(F.col("ck")) & (F.col("block") == F.col("cb")), "left")
    columns = {key: F.col("k"), time: F.col("t")} | {c: F.col(f"row.`{c}`") for c in names}
    return found.select(*(columns[c].alias(c) for c in left.columns), F.coalesce("own", "carried").alias(f"latest_{value}"))


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "n", blocks: int | None = None) -> DataFrame:
    """The number of each row within its key, in the given order (its first column is a time): the place in its block of
    time and the count of the key's rows in the blocks before."""
    rows = rows.withColumn("block", time_block(rows, order[0], blocks)) if "block" not in rows.columns else rows
    counts = rows.groupBy(key, "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("ck"), F.col("block").alias("cb"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy(key, "block").orderBy(*order))
    out = rows.withColumn("at", at).join(counts, F.col(key).eqNullSafe(F.col("ck")) & (F.col("block") == F.col("cb")))
    return out.withColumn(name, (F.col("at") + F.col("before")).cast("long")).drop("at", "block", "before", "ck", "cb")


def observed(table: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """`table` with counters that are filled as they are written, of a batch: the second part's `get` has them after."""
    seen = Observation(name)
    return table.observe(seen, *(c.alias(k) for k, c in metrics.items())), seen
