"""Entities, their values, and the hops between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_set
from ..lineage import cut
from ..model import Model

TECHNOLOGY, NODE, REGION, DRAWS = "hasTechnology", "atNode", "belongsToGeographicalRegion", "drawsFromHydraulicStorage"

#: Relations that lead to a series, the first one that is there counts.
PROFILES = ("hasAvailabilityProfile", "hasDemandProfile", "hasNaturalInflowProfile")


#: Parts of a forest that one task sorts, about.
PART_ROWS = 500_000


def entities(m: Model, entity_class: str, derived: bool = False) -> DataFrame:
    """Entities of a class; with `derived`, of its descendants too."""
    if not derived:
        return m.entity.where(F.col("entity_class") == entity_class)
    below = m.class_closure.where(F.col("ancestor") == entity_class).select(F.col("class_name").alias("entity_class"))
    return m.entity.join(below, "entity_class", "left_semi")


def values(m: Model, attribute: str, default: str | None = None, number: bool = False) -> DataFrame:
    """entity_id and the literal value of an attribute, for every entity (null, or the default, where it has none)."""
    column = "value_num" if number else "value_str"
    own = m.attr.where(F.col("attribute_id") == attribute).select("entity_id", F.col(column).alias("value"))
    out = m.entity.select("entity_id").join(own, "entity_id", "left")
    return out if default is None else out.withColumn("value", F.coalesce("value", F.lit(default).cast("double" if number else "string")))


def wide(m: Model, entity_class: str, attributes: list[str], number: bool = True, derived: bool = True) -> DataFrame:
    """One row for each entity with a column for each attribute."""
    column = "value_num" if number else "value_str"
    rows = m.attr.where(F.col("attribute_id").isin(*attributes))
    cells = [F.min(F.when(F.col("attribute_id") == a, F.col(column))).alias(a) for a in attributes]
    return entities(m, entity_class, derived).select("entity_class", "entity_id", "seq").join(rows.groupBy("entity_id").agg(*cells), "entity_id", "left")


def targets(m: Model, relation: str) -> DataFrame:
    """entity_id and its targets in order; blank ones dropped."""
    rows = m.rel.where((F.col("relation_id") == relation) & is_set(F.col("target_id")))
    return rows.groupBy("entity_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "target_id"))), lambda x: x["target_id"]).alias("targets"))


def first_target(m: Model, relation: str, name: str = "target_id") -> DataFrame:
    rows = m.rel.where((F.col("relation_id") == relation) & is_set(F.col("target_id")))
    return rows.groupBy("entity_id").agg(F.min_by("target_id", "ord").alias(name))


def sources(m: Model, relation: str) -> DataFrame:
    """The reverse edge: target_id and every entity that points at it."""
    return m.rel.where(F.col("relation_id") == relation).select("target_id", "entity_id").distinct()


def effective_values(m: Model, attribute: str) -> DataFrame:
    """entity_id and value: its own, else its technology's, else the schema's default."""
    own = m.attr.where((F.col("attribute_id") == attribute) & is_set(F.col("value_str"))).select("entity_id", F.col("value_str").alias("own"))
    technology = first_target(m, TECHNOLOGY, "technology")
    template = own.select(F.col("entity_id").alias("technology"), F.col("own").alias("template"))
    default = m.field_def.where((F.col("field_id") == attribute) & (F.col("kind") == "attribute")).select(F.col("class_name").alias("entity_class"), F.col("default"))
    rows = m.entity.select("entity_id", "entity_class").join(own, "entity_id", "left").join(technology, "entity_id", "left").join(template, "technology", "left")
    return rows.join(F.broadcast(default), "entity_class", "left").select("entity_id", F.coalesce("own", "template", "default").alias("value"))


def asset_nodes(m: Model, classes: list[str] | None = None) -> DataFrame:
    """entity_id and node: the first target of atNode."""
    found = first_target(m, NODE, "node")
    return found if classes is None else found.join(m.entity.where(F.col("entity_class").isin(*classes)).select("entity_id"), "entity_id", "left_semi")


def node_countries(m: Model, parse: Column | None = None) -> DataFrame:
    """node and country: that of its region, else of its own id, else `??`."""
    region = first_target(m, REGION, "region")
    country = F.when(F.col("region").isNotNull(), F.col("region") if parse is None else parse)
    own = F.when(F.col("node").rlike(r"^node\.[^.]+\."), F.upper(F.left(F.split_part("node", F.lit("."), F.lit(2)), F.lit(2))))
    nodes = m.rel.where(F.col("relation_id") == NODE).select(F.col("target_id").alias("node")).union(region.select("entity_id")).distinct()
    return nodes.join(region.withColumnRenamed("entity_id", "node"), "node", "left").select("node", F.coalesce(country, own, F.lit("??")).alias("country"))


def branch_ends(m: Model) -> DataFrame:
    """entity_id, from_node, to_node; either may be missing. An entity has two rows, which are brought together before
    they are sorted: to group them where they are read would save nothing."""
    ends = m.rel.where(F.col("relation_id").isin("fromNode", "toNode")).repartition("entity_id").groupBy("entity_id")
    end = lambda r, name: F.min_by("target_id", F.when(F.col("relation_id") == r, F.col("ord"))).alias(name)
    return ends.agg(end("fromNode", "from_node"), end("toNode", "to_node"))


def reservoir_nodes(m: Model, last: bool = False) -> DataFrame:
    """reservoir and the node of the generator that draws from it: of the first by load order, or the last."""
    pick = F.max_by if last else F.min_by
    rows = sources(m, DRAWS).join(m.entity.select("entity_id", "seq"), "entity_id").join(asset_nodes(m), "entity_id")
    return rows.groupBy(F.col("target_id").alias("reservoir")).agg(pick("node", "seq").alias("node"))


def pumped_reservoirs(m: Model, pumped: Column) -> DataFrame:
    """reservoir and whether any generator that draws from it is pumped (a condition on its row of `entity`)."""
    rows = sources(m, DRAWS).join(m.entity, "entity_id")
    return rows.groupBy(F.col("target_id").alias("reservoir")).agg(F.bool_or(pumped).alias("pumped"))


def reservoir_power(m: Model, attribute: str) -> DataFrame:
    """reservoir and the power of its generators; a generator without a link counts for the reservoir at its node if
    that is the only one there."""
    power = values(m, attribute, number=True).where("value is not null")
    direct = sources(m, DRAWS).select(F.col("target_id").alias("reservoir"), "entity_id")
    at = asset_nodes(m)
    reservoirs = entities(m, "HydraulicStorageUnit").select(F.col("entity_id").alias("reservoir")).join(at.withColumnRenamed("entity_id", "reservoir"), "reservoir")
    alone = reservoirs.groupBy("node").agg(F.count("*").alias("n"), F.min("reservoir").alias("reservoir")).where("n = 1")
    free = entities(m, "HydroGenerationUnit", derived=True).select("entity_id").join(direct, "entity_id", "left_anti").join(at, "entity_id")
    edges = direct.union(free.join(alone, "node").select("reservoir", "entity_id"))
    return edges.join(power, "entity_id").groupBy("reservoir").agg(F.sum("value").alias("power"))


def profile_links(m: Model) -> DataFrame:
    """entity_id and profile: availability before demand before inflow."""
    rank = F.array_position(F.array(*map(F.lit, PROFILES)), F.col("relation_id"))
    return m.rel.where(F.col("relation_id").isin(*PROFILES)).groupBy("entity_id").agg(F.min_by("target_id", F.struct(rank, F.col("ord"))).alias("profile"))


def results_of(m: Model) -> DataFrame:
    """asset, result class, field and the first set value over its results, by load order."""
    views = m.rel.where(F.col("relation_id") == "reportsOn").select("entity_id", F.col("target_id").alias("asset"))
    rows = views.join(m.attr.where(is_set(F.col("value_str"))), "entity_id").join(m.entity.select("entity_id", "seq"), "entity_id")
    return rows.groupBy("asset", "entity_class", "attribute_id").agg(F.min_by("value_str", "seq").alias("value"))


def library_scope(m: Model, scope: str = "referenced") -> DataFrame:
    """entity_id of what an export holds: `none`, `referenced` (what others reach over relations) or `all` of the
    library beside the rest. The frontier is joined again until nothing new is met."""
    own = m.entity.where(~F.coalesce("is_library", F.lit(False))).select("entity_id")
    if scope != "referenced":
        return own if scope == "none" else m.entity.select("entity_id")
    library = m.entity.where("is_library").select(F.col("entity_id").alias("target_id"))
    edges = m.rel.select("entity_id", "target_id").distinct().join(library, "target_id", "left_semi").select("entity_id", "target_id")
    seen, frontier = own, own
    while True:
        met = edges.join(frontier, "entity_id", "left_semi").select(F.col("target_id").alias("entity_id")).distinct()
        frontier = cut(met.join(seen, "entity_id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def tree(parts: DataFrame) -> DataFrame:
    """node, depth and path (keys from the root, joined by `/`) of a forest of parts (node, parent, key): a recursive query,
    whose order by path lists every part under its parent. A part whose parent is null or unknown is a root; parts of a
    cycle hang below no root and are left out. Tasks are as many as the parts ask for."""
    rows = parts.count()
    known = parts.select(F.col("node").alias("parent"))
    if rows > PART_ROWS:  # by number, so that small rows are not put together again by their bytes
        n = max(-(-rows // PART_ROWS), int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        parts, known = parts.repartition(n, "parent"), known.repartition(n, "parent")
    tops = parts.join(known, "parent", "left_anti").select("node", "key")
    return parts.sparkSession.sql(
        """WITH RECURSIVE t(node, depth, path) AS (
            SELECT node, 0, key FROM {tops}
            UNION ALL SELECT p.node, t.depth + 1, concat(t.path, '/', p.key) FROM {parts} p JOIN t ON p.parent = t.node)
        SELECT * FROM t LIMIT ALL""",
        tops=tops,
        parts=parts,
    )


def class_tree(m: Model, root: str) -> DataFrame:
    """class_name and depth below a root."""
    return m.class_closure.where(F.col("ancestor") == root).select("class_name", "depth")


def grouped_fields(m: Model, entity_class: str, group: str | None = None) -> DataFrame:
    """Fields of a class in order; with `group`, those that belong to it."""
    rows = m.field_def.where(F.col("class_name") == entity_class)
    rows = rows if group is None else rows.where(F.array_contains("groups", group))
    return rows.orderBy(F.coalesce("ord", F.lit(0)), "field_id")
