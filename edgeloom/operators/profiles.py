"""Time series as long rows (profile_id, t, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normalised(profiles: DataFrame, negative: bool = False) -> DataFrame:
    """Values over their series' sum (over its size, with `negative`, so withdrawals sum to -1); a series that sums to
    0 stays."""
    whole = F.sum("value").over(Window.partitionBy("profile_id"))
    return profiles.withColumn("value", F.when(whole == 0, F.col("value")).otherwise(F.col("value") / (F.abs(whole) if negative else whole)))


def combined(profiles: DataFrame, members: DataFrame, divide: bool = True) -> DataFrame:
    """The weighted sum of the series of each group of `members` (group_id, profile_id, weight), divided by the weight
    that took part. Members without weight or without a series are left out."""
    weighed = members.where("weight > 0")
    rows = profiles.join(weighed, "profile_id").groupBy(F.col("group_id").alias("profile_id"), "t").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    if not divide:
        return rows
    present = weighed.join(profiles.select("profile_id").distinct(), "profile_id", "left_semi").groupBy(F.col("group_id").alias("profile_id")).agg(F.sum("weight").alias("w"))
    return rows.join(present, "profile_id").select("profile_id", "t", (F.col("value") / F.col("w")).alias("value"))


def annual(profiles: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """profile_id and its sum, weighed by (t, weight) where given (1 where a step has none)."""
    rows = profiles if weights is None else profiles.join(weights, "t", "left")
    weight = F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(1.0))
    return rows.groupBy("profile_id").agg(F.sum(F.col("value") * weight).alias("annual"))


def from_hours(rows: DataFrame, keys: list[str], hours: list[str]) -> DataFrame:
    """Long rows (keys, t, value) of a table with a column for each step: one array, not thousands of branches. What is
    no number counts as 0."""
    cells = F.array(*(F.coalesce(F.col(f"`{h}`").cast("string").try_cast("double"), F.lit(0.0)) for h in hours))
    return rows.select(*keys, F.posexplode(cells).alias("t", "value"))


def grouped_hours(rows: DataFrame, keys: list[str], hours: list[str]) -> DataFrame:
    """The sum over rows with the same keys, null keys together."""
    return from_hours(rows, keys, hours).groupBy(*keys, "t").agg(F.sum("value").alias("value"))


def padded(profiles: DataFrame, keys: list[str], length: int, day: int = 24) -> DataFrame:
    """A year that lacks its last day gets the day before once more."""
    tail = profiles.where((F.col("t") >= length - 2 * day) & (F.col("t") < length - day)).withColumn("t", F.col("t") + day)
    whole = profiles.groupBy(*keys).agg(F.max("t").alias("last")).where(F.col("last") == length - day - 1).drop("last")
    return profiles.unionByName(tail.join(whole, keys, "left_semi"))


def on_axis(profiles: DataFrame, length: int) -> DataFrame:
    """Every series with every step: missing values are 0, later ones are cut off."""
    axis = F.explode(F.sequence(F.lit(0), F.lit(length - 1)))
    every = profiles.select("profile_id").distinct().withColumn("t", axis)
    return every.join(profiles, ["profile_id", "t"], "left").fillna(0.0, ["value"])


def synthetic(spark: SparkSession, kind: str, hours: int = 8760, scale: float = 1.0) -> DataFrame:
    """(profile_id, t, value) of a made-up series: `solar` (a clipped day wave in a year wave), `wind` (two slow waves,
    kept between 0 and 1), `demand` (a day wave around 1) or `decay` (falls to 1/e in a year)."""
    t = F.col("t")
    day, year = 2 * math.pi * t / 24, 2 * math.pi * t / hours
    shapes = {
        "solar": F.greatest(F.lit(0.0), F.sin(day - math.pi / 2)) * (0.6 - 0.4 * F.cos(year)),
        "wind": F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 + 0.3 * F.sin(2 * math.pi * t / 73) + 0.2 * F.cos(year))),
        "demand": 1.0 + 0.2 * F.sin(day - math.pi / 2) + 0.1 * F.cos(year),
        "decay": F.exp(-t / hours),
    }
    return spark.range(hours).select(F.lit(kind).alias("profile_id"), F.col("id").cast("int").alias("t")).withColumn("value", shapes[kind] * scale)
