"""Report aggregates. Keys, measures and filters are columns of the given table, so each is one grouped pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Model
from .navigation import NODE, REGION, entities

MONEY = "decimal(18,2)"


def exact_sum(c: Column) -> Column:
    """A sum that does not depend on the order of rows: over cents."""
    return F.coalesce(F.sum(c.cast(MONEY)), F.lit(0)).cast("double")


def entity_counts(m: Model) -> DataFrame:
    return m.entity.groupBy("entity_class").agg(F.count("*").alias("n"))


def summary(m: Model, detailed: bool = False) -> DataFrame:
    """Counts of asset classes, by class or by top-level family; most first, then by label."""
    label = F.col("entity_class" if detailed else "top_family").alias("label")
    rows = m.entity.join(m.class_def.where("role = 'asset'"), m.entity["entity_class"] == m.class_def["class_name"])
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def total_capacity(m: Model, asset_class: str, region: str | None = None, attribute: str = "nominal_power_capacity") -> DataFrame:
    """One row: the sum over a class and its descendants, in a region if one is given (any node in it counts)."""
    rows = entities(m, asset_class, derived=True).select("entity_id")
    if region is not None:
        nodes = m.rel.where((F.col("relation_id") == REGION) & (F.col("target_id") == region)).select(F.col("entity_id").alias("target_id"))
        rows = rows.join(m.rel.where(F.col("relation_id") == NODE).join(nodes, "target_id", "left_semi"), "entity_id", "left_semi")
    return rows.join(m.attr.where(F.col("attribute_id") == attribute), "entity_id").agg(exact_sum(F.col("value_num")).alias("total"))


def totals(rows: DataFrame, keys: list[str], value: Column, name: str = "total") -> DataFrame:
    return rows.groupBy(*keys).agg(exact_sum(value).alias(name))


def totals_with_subtotals(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Totals over every prefix of the keys; `level` counts the keys that are summed over."""
    return rows.rollup(*keys).agg(exact_sum(value).alias("total"), reduce(lambda a, b: a + b, [F.grouping(k).cast("long") for k in keys]).alias("level"))


def histogram(rows: DataFrame, value: Column, name: str = "bin") -> DataFrame:
    """Counts by a value rounded half to even."""
    return rows.groupBy(F.bround(value, 0).cast("long").alias(name)).agg(F.count("*").alias("n"))


def cross_border(flows: DataFrame, a: str, b: str, forward: Column, backward: Column, oriented: bool = True) -> DataFrame:
    """Capacity between unordered pairs of different countries; only positive values count. Unless `oriented`, a pair
    that is turned round keeps its forward value as forward."""
    turned = F.col(a) > F.col(b) if oriented else F.lit(False)
    positive = lambda c: F.when(c > 0, c)
    rows = flows.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("country_a"),
        F.greatest(a, b).alias("country_b"),
        F.when(turned, backward).otherwise(forward).alias("f"),
        F.when(turned, forward).otherwise(backward).alias("g"),
    )
    return rows.groupBy("country_a", "country_b").agg(exact_sum(positive(F.col("f"))).alias("fwd"), exact_sum(positive(F.col("g"))).alias("bwd"))


def weighted_average(value: Column, weight: Column) -> Column:
    """Pairs with a null or a zero weight are left out; null without weight. Decimals are summed as such, so that the
    order of rows does not matter to them."""
    ok = value.isNotNull() & weight.isNotNull() & (weight != 0)
    return F.sum(F.when(ok, value * weight)).cast("double") / F.nullif(F.sum(F.when(ok, weight)).cast("double"), F.lit(0.0))


def dominant(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value of each group, of equally frequent ones the one met first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where("rank = 1").select(*keys, value, "n")


def shares(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row's share of its group's total; 0 where that is 0."""
    whole = F.sum(value).over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.when(whole != 0, F.col(value) / whole).otherwise(0.0))


def conservation(before: DataFrame, after: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Totals of two states side by side and whether they agree."""
    x, y = (t.groupBy(*keys).agg(F.sum(value).alias(n)) for t, n in ((before, "before"), (after, "after")))
    rows = x.join(y, keys, "full_outer").fillna(0.0, ["before", "after"])
    near = F.abs(F.col("before") - F.col("after")) <= F.greatest(tolerance * F.greatest(F.abs("before"), F.abs("after")), F.lit(tolerance))
    return rows.withColumn("ok", near)


def country_totals(rows: DataFrame, measures: dict[str, Column], skip_unknown: bool = False) -> DataFrame:
    """Long totals (country, category, technology, total) of a table with `country` and `technology`, a row for each
    measure that is not null."""
    cells = F.array(*(F.struct(F.lit(k).alias("category"), v.cast("double").alias("v")) for k, v in measures.items()))
    out = rows.select("country", "technology", F.explode(cells).alias("c")).where("c.v is not null")
    out = out.where("country <> '??'") if skip_unknown else out
    return out.groupBy("country", "technology", F.col("c.category").alias("category")).agg(exact_sum(F.col("c.v")).alias("total"))


def branch_summary(branches: DataFrame, length: Column, parallel: Column, mva: Column) -> DataFrame:
    """Number, kilometres of circuits (no or zero parallel counts as one) and rating."""
    circuits = F.coalesce(F.nullif(parallel, F.lit(0)), F.lit(1))
    return branches.agg(F.count("*").alias("n"), exact_sum(length * circuits).alias("km"), exact_sum(mva).alias("mva"))


def top(rows: DataFrame, value: str, key: str, most: int) -> DataFrame:
    """The rows of largest value, of equal ones those of smallest key: kept as a heap in each task, never sorted whole."""
    return rows.orderBy(F.desc(value), key).limit(most)


def pair_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The number of rows from each a to each b."""
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def both_and_only(a: DataFrame, b: DataFrame, name: str = "side") -> DataFrame:
    """The distinct rows of `a`, marked `both` where `b` has them too and `only` where it does not."""
    return a.intersect(b).withColumn(name, F.lit("both")).union(a.subtract(b).withColumn(name, F.lit("only")))


def run_summary(parts: dict[str, DataFrame]) -> str:
    """A text with the rows of small reports under their titles."""
    out = []
    for title, rows in parts.items():
        out.append(title)
        out += ["  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows.limit(200).collect()]
    return "\n".join(out) + "\n"
