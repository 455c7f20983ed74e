"""A part of a model around chosen buses, every asset as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_set
from ..lineage import cut
from ..model import Model
from .country import GENERATION
from .navigation import DRAWS, NODE, PROFILES, REGION

BRANCHES = ("TransmissionLine", "GenericInterconnector", "HVDCLink", "Transformer")
#: Classes that are kept whole.
KEPT = ("Carrier", "NaturalResource", "CarrierDomain", "TimestampSeries")


def hops(m: Model) -> DataFrame:
    """entity_class, entity_id, and where an entity stands and leads to (node, from_node, to_node, reservoir, profile): one
    grouped pass over the relations."""
    first = lambda relation, name: F.min_by("target_id", F.when((F.col("relation_id") == relation) & is_set(F.col("target_id")), F.col("ord"))).alias(name)
    order = F.array_position(F.array(*map(F.lit, PROFILES)), F.col("relation_id"))
    profile = F.min_by("target_id", F.when(F.col("relation_id").isin(*PROFILES), F.struct(order, F.col("ord")))).alias("profile")
    rows = m.rel.where(F.col("relation_id").isin(NODE, "fromNode", "toNode", DRAWS, *PROFILES)).repartition("entity_id").groupBy("entity_id")
    rows = rows.agg(first(NODE, "node"), first("fromNode", "from_node"), first("toNode", "to_node"), first(DRAWS, "reservoir"), profile)
    return m.entity.select("entity_class", "entity_id").join(rows, "entity_id", "left")


def kept_entities(m: Model, buses: DataFrame, bus_class: str = "ElectricalBus") -> DataFrame:
    """entity_id of what stays with the `buses` (bus): assets at one of them, branches with both ends there, reservoirs
    that a kept generator draws from, the regions of kept buses, the profiles of kept assets, and what belongs to no
    place. A chain of semi joins; nothing of it has to fit anywhere."""
    buses, rows = cut(buses.select("bus").distinct()), cut(hops(m))
    of = lambda *classes: rows.where(F.col("entity_class").isin(*classes))
    near = lambda t, end: t.join(buses.toDF(end), end, "left_semi")
    ids = lambda t, name="entity_id": t.select(F.col(name).alias("entity_id"))
    stores = of("HydraulicStorageUnit").join(ids(near(of("HydroGenerationUnit"), "node"), "reservoir"), "entity_id", "left_semi")
    assets = near(of(*GENERATION, "DemandUnit", "StorageUnit"), "node").select(*rows.columns).union(stores.select(*rows.columns))
    regions = m.rel.where(F.col("relation_id") == REGION).join(buses.toDF("entity_id"), "entity_id", "left_semi")
    named = ids(regions, "target_id").join(ids(of("GeographicalRegion")), "entity_id", "left_semi").union(ids(assets, "profile").join(ids(of("Profile")), "entity_id", "left_semi"))
    there = ids(near(near(of(*BRANCHES), "from_node"), "to_node")).union(ids(of(bus_class)).join(buses.toDF("entity_id"), "entity_id", "left_semi"))
    return ids(assets).union(there).union(named).union(ids(of(*KEPT))).distinct()


def subset(m: Model, buses: DataFrame, bus_class: str = "ElectricalBus") -> Model:
    """The model of the kept entities, with the series of kept profiles."""
    kept = kept_entities(m, buses, bus_class)
    part = lambda t: t.join(kept, "entity_id", "left_semi").select(*t.columns)
    series = m.profile_value.join(kept.toDF("profile_id"), "profile_id", "left_semi").select(*m.profile_value.columns)
    return m.but(entity=part(m.entity), attr=part(m.attr), rel=part(m.rel), profile_value=series)


def dropped_counts(m: Model, buses: DataFrame, bus_class: str = "ElectricalBus") -> DataFrame:
    """entity_class, kept and gone: what a subset keeps and leaves out."""
    kept = kept_entities(m, buses, bus_class).withColumn("stays", F.lit(1))
    rows = m.entity.join(kept, "entity_id", "left")
    return rows.groupBy("entity_class").agg(F.count("stays").alias("kept"), (F.count("*") - F.count("stays")).alias("gone"))
