"""Hourly market tables to capacities, energies and normalised profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import decided
from ..functions.numbers import to_double
from ..functions.text import id_tag
from ..lineage import cut
from ..model import Model
from .etl import carry_forward, with_increments
from .mutation import add_entities, set_attributes, set_relations
from .navigation import first_target
from .profiles import grouped_hours, normalised, padded

#: Fixed value: hours of a full year of the source files.
YEAR_HOURS = 8784


def selected(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have the given values; names with `_` stand for blanks."""
    for name, v in equal.items():
        rows = rows.where(F.col(f"`{name.replace('_', ' ')}`").cast("string") == str(v))
    return rows


def installed_capacities(rows: DataFrame, policy: str, year: int, climate: int, classify: Column) -> DataFrame:
    """Node, asset class and capacity: one policy and climate year, the latest year up to the wanted one for each node
    and type, values of installed or charging capacity that are not 0, summed by class."""
    rows = selected(rows, Policy=policy, Climate_Year=climate).where(F.lower("Variable").rlike("installed|charging"))
    rows = rows.withColumns({"Year": F.col("Year").try_cast("int"), "Value": to_double(F.col("Value"))}).where("Value <> 0")
    latest = carry_forward(rows, ["Node", "Type", "Variable"], "Year", year)
    return latest.withColumn("asset_class", classify).where("asset_class is not null").groupBy("Node", "asset_class").agg(F.sum("Value").alias("capacity"))


def demand(rows: DataFrame, keys: list[str], hours: list[str], length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, annual) and the profiles (profile_id, t, value) that sum to -1: rows with the same keys are added, a year
    without its last day is padded, and sizes count."""
    long = grouped_hours(rows, keys, hours).withColumn("value", F.abs("value"))
    long = padded(long, keys, length) if length else long
    annual = long.groupBy(*keys).agg(F.sum("value").alias("annual"))
    series = long.select(F.concat_ws(".", *keys).alias("profile_id"), "t", (-F.col("value")).alias("value"))
    return annual, normalised(series, negative=True)


def renewables(factors: DataFrame, capacities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile_id, annual), the sum of capacity factors times capacity, and the profiles normalised to 1."""
    sums = factors.groupBy("profile_id").agg(F.sum("value").alias("full_load"))
    annual = sums.join(capacities, "profile_id").select("profile_id", (F.col("full_load") * F.col("capacity")).alias("annual"))
    return annual, normalised(factors)


#: What the type of an inflow is called in the files, and in the ids of its assets.
INFLOWS = [("Reservoir", "reservoir"), ("PS Open", "pump_storage_open_loop"), ("PS Cloa?se", "pump_storage_closed_loop"), ("Pondage", "pondage"), ("Run of River", "run_of_river")]


def inflow_series(rows: DataFrame, hours: list[str], node: str = "Node", kind: str = "Type") -> DataFrame:
    """(entity_id, t, value): the hourly inflows of a wide table, summed over rows of the same asset; types without a name
    in INFLOWS are left out."""
    of = rows.withColumn("__kind", decided(F.coalesce(F.col(kind), F.lit("")), INFLOWS)).where("__kind IS NOT NULL")
    return grouped_hours(of.withColumn("entity_id", F.concat(F.lit("tech."), "__kind", F.lit("."), id_tag(F.col(node)))), ["entity_id"], hours)


def drawing_generators(m: Model) -> DataFrame:
    """(storage, generator): the first generator, by load order, of those that draw from a reservoir."""
    draws = m.rel.where("relation_id = 'drawsFromHydraulicStorage'").select("entity_id", F.col("target_id").alias("storage"))
    return draws.join(m.entity.select("entity_id", "seq"), "entity_id").groupBy("storage").agg(F.min_by("entity_id", F.struct("seq", "entity_id")).alias("generator"))


def assign_inflows(m: Model, inflows: DataFrame, pairs: DataFrame | None = None) -> Model:
    """The model with annual inflows and their profiles, from (entity_id, t, value); those of unknown assets, and those that
    sum to 0, are left out.

    A store gets annual_natural_inflow_energy and the profile, and its paired generator (storage, generator; without
    `pairs` the first that draws from it) the same energy as annual_resource_potential. A generator gets its own energy as
    annual_resource_potential, also where a store is paired with it; its profile goes to the reservoir that a hydro
    generator draws from, if that has none of its own (of several generators the first in load order), else to itself as
    availability."""
    pairs = drawing_generators(m) if pairs is None else pairs
    sums = inflows.groupBy("entity_id").agg(F.sum("value").alias("annual")).where("annual <> 0")
    of = cut(sums.join(m.entity.select("entity_id", "entity_class", "seq"), "entity_id").where(F.col("entity_class").isin("GenerationUnit", "HydroGenerationUnit", "StorageUnit", "HydraulicStorageUnit")))
    of = of.withColumn("profile", F.concat(F.lit("profile.inflow."), "entity_id"))
    store = F.col("entity_class").isin("StorageUnit", "HydraulicStorageUnit")
    stores, units = of.where(store), of.where(~store)
    known = m.entity.select(F.col("entity_id").alias("generator"), F.col("entity_class").alias("class"))
    mirrored = stores.join(pairs, F.col("entity_id") == F.col("storage")).join(known, "generator").join(units.select(F.col("entity_id").alias("generator")), "generator", "left_anti")
    value = lambda rows, class_, id_, name: rows.select(F.col(class_).alias("entity_class"), F.col(id_).alias("entity_id"), F.lit(name).alias("attribute_id"), F.col("annual").cast("string").alias("value_str"), F.col("annual").alias("value_num"), F.lit(None).cast("boolean").alias("value_bool"), F.lit("MWh").alias("unit"), F.lit(None).cast("string").alias("provenance_ref"))
    values = value(stores, "entity_class", "entity_id", "annual_natural_inflow_energy").union(value(units, "entity_class", "entity_id", "annual_resource_potential")).union(value(mirrored, "class", "generator", "annual_resource_potential"))
    hydro = units.where("entity_class = 'HydroGenerationUnit'").join(first_target(m, "drawsFromHydraulicStorage", "reservoir"), "entity_id")
    lent = hydro.groupBy("reservoir").agg(F.min_by("profile", F.struct("seq", "entity_id")).alias("profile")).withColumnRenamed("reservoir", "entity_id")
    lent = lent.join(m.entity.select("entity_id", "entity_class"), "entity_id").join(stores.select("entity_id"), "entity_id", "left_anti")
    own = units.join(hydro.select("entity_id"), "entity_id", "left_anti")
    edge = lambda rows, name: rows.select("entity_class", "entity_id", F.lit(name).alias("relation_id"), F.col("profile").alias("target_id"), F.lit(0).alias("ord"))
    edges = edge(stores, "hasNaturalInflowProfile").union(edge(lent, "hasNaturalInflowProfile")).union(edge(own, "hasAvailabilityProfile"))
    series = inflows.join(of.select("entity_id", F.col("profile").alias("profile_id"), "annual"), "entity_id").select("profile_id", F.col("t").cast("int").alias("t"), (F.col("value") / F.col("annual")).alias("value"))
    profiles = of.select(F.lit("Profile").alias("entity_class"), F.col("profile").alias("entity_id"), F.lit(False).alias("is_library"), "seq")
    old = m.profile_value.join(of.select(F.col("profile").alias("profile_id")), "profile_id", "left_anti").select("profile_id", "t", "value")
    out = set_relations(set_attributes(add_entities(m, profiles), values), edges)
    return out.but(profile_value=old.unionByName(series))


def storage_energy(reservoirs: DataFrame, energies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reservoirs with their energy, and the ids in `energies` that no reservoir has."""
    return reservoirs.join(energies, "id", "left"), energies.join(reservoirs, "id", "left_anti")


def transfer_capacities(rows: DataFrame, year: int) -> DataFrame:
    """FROM, TO, p12, p21: the base values of the latest year up to the wanted one plus the increments up to it."""
    rows = rows.withColumns({"YEAR": F.col("YEAR").try_cast("int"), "P12": to_double(F.col("P12")), "P21": to_double(F.col("P21"))})
    base = carry_forward(rows.where(~F.lower("TYPE").contains("increment")), ["FROM", "TO"], "YEAR", year)
    base = base.groupBy("FROM", "TO").agg(F.sum("P12").alias("P12"), F.sum("P21").alias("P21"))
    more = rows.where(F.lower("TYPE").contains("increment") & (F.col("YEAR") <= year))
    out = with_increments(base, more.select("FROM", "TO", "P12"), ["FROM", "TO"], "P12")
    return with_increments(out, more.select("FROM", "TO", "P21"), ["FROM", "TO"], "P21").select("FROM", "TO", F.col("P12").alias("p12"), F.col("P21").alias("p21"))


def energy_balance(rows: DataFrame, hours: int = 8760) -> DataFrame:
    """Annual energy by country with a grand total (country null): rows have country, kind (dispatchable, variable,
    hydro, demand), capacity, and energy where the kind has one."""
    amount = F.when(F.col("kind") == "dispatchable", F.col("capacity") * hours).otherwise(F.coalesce("energy", F.lit(0.0)))
    cells = [F.coalesce(F.sum(F.when(F.col("kind") == k, amount.cast("decimal(18,2)"))), F.lit(0)).cast("double").alias(k) for k in ("dispatchable", "variable", "hydro", "demand")]
    return rows.rollup("country").agg(*cells)


def winners(rows: DataFrame, key: str, id_: str, prefixes: list[str]) -> DataFrame:
    """Of rows with the same key the one whose id has the earliest prefix in the list, then the smallest id."""
    rank = F.lit(len(prefixes))
    for k in range(len(prefixes) - 1, -1, -1):
        rank = F.when(F.col(id_).startswith(prefixes[k]), k).otherwise(rank)
    order = Window.partitionBy(key).orderBy(rank, id_)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def nodes_and_countries(rows: DataFrame, node: str = "Node") -> tuple[DataFrame, DataFrame]:
    """(node, country) of the nodes of a table, whose first two letters name the country, and (country) of all."""
    nodes = rows.select(F.trim(F.col(node)).alias("node")).where("node IS NOT NULL AND node <> ''").distinct()
    nodes = nodes.withColumn("country", F.upper(F.left("node", F.lit(2))))
    return nodes, nodes.select("country").distinct()


def conversion_demand(rows: DataFrame, policy: str, year: int, climate: int, words: tuple[str, ...]) -> DataFrame:
    """node and demand: the sizes of the capacities of types that hold one of the words (electrolyser, heat pump), of the
    latest year up to the wanted one, summed."""
    rows = selected(rows, Policy=policy, Climate_Year=climate).where(F.lower("Type").rlike("|".join(words)))
    rows = rows.withColumns({"Year": F.col("Year").try_cast("int"), "Value": F.abs(to_double(F.col("Value")))}).where("Value > 0")
    latest = carry_forward(rows, ["Node", "Type", "Variable"], "Year", year)
    return latest.groupBy(F.col("Node").alias("node")).agg(F.sum("Value").alias("demand"))
