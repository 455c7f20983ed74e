"""The write path: each operator returns a model with new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import FLAGS, INTEGERS, NUMBERS, safe_double, to_bool, to_double, to_long
from ..functions.text import is_set
from ..lineage import cut
from ..model import Model
from ..plans.validation import raise_for, value_rules


def _latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def add_entities(m: Model, rows: DataFrame, defaults: bool = True) -> Model:
    """Entities with new ids; known ids are left as they are. Defaults of ungrouped attributes are set."""
    first = Window.partitionBy("entity_id").orderBy("seq")
    known = m.entity.select("entity_id")
    new = rows.select(*m.entity.columns, F.row_number().over(first).alias("n")).where("n = 1").join(known, "entity_id", "left_anti").select(*m.entity.columns)
    out = m.but(entity=m.entity.unionByName(new))
    if not defaults:
        return out
    given = m.field_def.where("kind = 'attribute' and default is not null and size(groups) = 0")
    values = new.join(F.broadcast(given), new["entity_class"] == given["class_name"]).select(
        "entity_class", "entity_id", F.col("field_id").alias("attribute_id"), F.col("default").alias("value_str"), F.col("default").try_cast("double").alias("value_num"),
        F.when(F.lower("dtype").isin("bool", "boolean"), F.lower("default").isin("true", "1", "yes")).alias("value_bool"), F.get("units", F.lit(0)).alias("unit"), F.lit(None).cast("string").alias("provenance_ref"),
    )
    return out.but(attr=m.attr.unionByName(values))


def set_attributes(m: Model, rows: DataFrame) -> Model:
    """The last value of each (entity, attribute) replaces what was there."""
    return m.but(attr=_latest(m.attr, rows, ["entity_id", "attribute_id"]))


#: What becomes of a value that breaks a rule: those of the first kind are written and reported, all others are not written.
REPORTED = ("enum", "minimum", "maximum")


def checked_attributes(m: Model, rows: DataFrame) -> DataFrame:
    """`rows` (entity_id, attribute_id, value_str; unit, provenance_ref and ord where they are there) as typed values of
    the model, with `broken`, an array of (rule, policy, detail). Rules: `entity` and `field` (unknown), `type`, `pattern`,
    `unit` (policy `rejected`), `enum`, `minimum`, `maximum` (policy `reported`).

    Numbers lose blanks, decimal commas and, where the type is integer, fractions; flags become true or false; a value
    without a unit gets the field's first one. An empty or null value has no type or limit to break, but a pattern."""
    have = set(rows.columns)
    optional = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    given = rows.select("entity_id", "attribute_id", F.col("value_str").cast("string").alias("raw"), optional("unit", "string"), optional("provenance_ref", "string"), optional("ord", "long"))
    field = m.field_def.where("kind = 'attribute'").select(F.col("class_name").alias("entity_class"), F.col("field_id").alias("attribute_id"), "dtype", "minimum", "maximum", "enum", "pattern", "units")
    of = given.join(m.entity.select("entity_id", "entity_class").distinct(), "entity_id", "left").join(F.broadcast(field), ["entity_class", "attribute_id"], "left")
    low, filled = F.lower("dtype"), is_set(F.coalesce("raw", F.lit("")))
    number = F.when(low.isin(*NUMBERS), to_double(F.col("raw"))).when(low.isin(*INTEGERS), to_long(F.col("raw")).cast("double")).otherwise(safe_double(F.col("raw")))
    flag = F.when(low.isin(*FLAGS), to_bool(F.col("raw")))
    whole = F.when(low.isin(*INTEGERS), to_long(F.col("raw")).cast("string")).when(low.isin(*NUMBERS), to_double(F.col("raw")).cast("string")).when(low.isin(*FLAGS), flag.cast("string"))
    of = of.withColumns({"value_str": F.coalesce("raw", F.lit("")), "unit": F.coalesce(F.nullif("unit", F.lit("")), F.get("units", F.lit(0)))})
    rules = value_rules()
    always = {"entity": F.col("entity_class").isNull(), "field": F.col("entity_class").isNotNull() & F.col("dtype").isNull()}
    found = {r: (bad, F.col("attribute_id") if r == "field" else F.col("entity_id")) for r, bad in always.items()}
    found |= {r: (bad if r in ("pattern", "unit") else bad & filled, detail) for r, (bad, detail) in rules.items()}
    policy = lambda r: F.lit("reported" if r in REPORTED else "rejected").alias("policy")
    each = [F.when(bad, F.struct(F.lit(r).alias("rule"), policy(r), detail.cast("string").alias("detail"))) for r, (bad, detail) in found.items()]
    of = of.withColumn("broken", F.filter(F.array(*each), lambda v: v.isNotNull()))
    return of.select("entity_class", "entity_id", "attribute_id", F.coalesce(whole, "value_str").alias("value_str"), number.alias("value_num"), flag.alias("value_bool"), "unit", "provenance_ref", "ord", "broken")


def write_attributes(m: Model, rows: DataFrame, strict: bool = False) -> tuple[Model, DataFrame]:
    """The model with the values that may be written, and the side table of what breaks a rule: entity_class, entity_id,
    field_id, rule, policy, detail. The rows are checked once, in one pass that both results read. Of several values of one
    field the one with the largest `ord` stays (of equal ones the largest value). With `strict`, a rejected row raises."""
    checked = cut(checked_attributes(m, rows))
    side = checked.select("entity_class", "entity_id", F.col("attribute_id").alias("field_id"), F.explode("broken").alias("b")).select("entity_class", "entity_id", "field_id", "b.*")
    if strict:
        raise_for(side.where("policy = 'rejected'"))
    good = checked.where(~F.exists("broken", lambda b: b["policy"] == "rejected"))
    names = [c for c in m.attr.columns if c not in ("entity_id", "attribute_id")]
    last = good.groupBy("entity_id", "attribute_id").agg(F.max(F.struct(F.coalesce("ord", F.lit(0)).alias("ord"), "value_str", *(c for c in names if c != "value_str"))).alias("v"))
    return set_attributes(m, last.select("entity_id", "attribute_id", *(F.col(f"v.{c}").alias(c) for c in names))), side


def set_relations(m: Model, rows: DataFrame) -> Model:
    """All targets of each (entity, relation) are replaced."""
    return m.but(rel=_latest(m.rel, rows, ["entity_id", "relation_id"]))


def set_relations_if_allowed(m: Model, rows: DataFrame) -> Model:
    """Only relations that the class knows and whose target exists."""
    known = m.field_def.where("kind = 'relation'").select(F.col("class_name").alias("entity_class"), F.col("field_id").alias("relation_id"))
    there = m.entity.select(F.col("entity_id").alias("target_id"))
    return set_relations(m, rows.join(F.broadcast(known), ["entity_class", "relation_id"], "left_semi").join(there, "target_id", "left_semi"))


def import_library(m: Model, other: Model, namespace: str | None = None, conflict: str = "error") -> Model:
    """The entities of another model as library rows. Ids and local targets get the prefix `<namespace>.`; an id that
    is there already is an error, is skipped, or is overwritten."""
    local = other.entity.select(F.col("entity_id").alias("local")).distinct()
    if namespace:
        named = F.concat(F.lit(f"{namespace}."), F.col("entity_id"))
        targets = other.rel.join(local, F.col("target_id") == F.col("local"), "left")
        rel = targets.withColumn("target_id", F.when(F.col("local").isNotNull(), F.concat(F.lit(f"{namespace}."), F.col("target_id"))).otherwise(F.col("target_id")))
        other = other.but(entity=other.entity.withColumn("entity_id", named), attr=other.attr.withColumn("entity_id", named), rel=rel.withColumn("entity_id", named).drop("local"))
    both = other.entity.select("entity_id").join(m.entity.select("entity_id"), "entity_id", "left_semi")
    if conflict == "error" and not both.isEmpty():
        raise ValueError("ids exist already: " + ", ".join(r[0] for r in both.orderBy("entity_id").limit(20).collect()))
    if conflict == "overwrite":
        m = m.but(**{t: getattr(m, t).join(both, "entity_id", "left_anti").select(*getattr(m, t).columns) for t in ("entity", "attr", "rel")})
    else:
        other = other.but(**{t: getattr(other, t).join(both, "entity_id", "left_anti").select(*getattr(other, t).columns) for t in ("entity", "attr", "rel")})
    rows = other.entity.withColumn("is_library", F.lit(True))
    return m.but(entity=m.entity.unionByName(rows.select(*m.entity.columns)), attr=m.attr.unionByName(other.attr.select(*m.attr.columns)), rel=m.rel.unionByName(other.rel.select(*m.rel.columns)))


def duplicate_ids(m: Model) -> DataFrame:
    return m.entity.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")


def aliased(m: Model, classes: dict[str, str] | None = None, attributes: dict[str, str] | None = None, relations: dict[str, str] | None = None) -> Model:
    """The model with other names of classes, attributes and relations replaced by their ids (alias -> id)."""
    def named(table: DataFrame, column: str, aliases: dict[str, str] | None) -> DataFrame:
        pairs = F.create_map(*(F.lit(x) for pair in (aliases or {}).items() for x in pair)) if aliases else None
        return table if pairs is None else table.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))

    of_class = lambda t: named(t, "entity_class", classes)
    return m.but(entity=of_class(m.entity), attr=named(of_class(m.attr), "attribute_id", attributes), rel=named(of_class(m.rel), "relation_id", relations))


def without_legacy(m: Model) -> Model:
    """Older forms rewritten: a true `is_reversible` is `hydro_machine_kind = reversible` (a false one goes), and a true
    `is_reference_port` of a port becomes the edge hasReferencePort of the unit that the port belongs to, if it is known."""
    flag = F.coalesce("value_bool", F.lower("value_str").isin("true", "1", "yes"), F.lit(False))
    old = m.attr.where("attribute_id = 'is_reversible'").where(flag)
    new = old.withColumns({"attribute_id": F.lit("hydro_machine_kind"), "value_str": F.lit("reversible"), "value_num": F.lit(None).cast("double"), "value_bool": F.lit(None).cast("boolean")})
    ports = m.attr.where("attribute_id = 'is_reference_port'").where(flag).select(F.col("entity_id").alias("port"))
    units = m.rel.where("relation_id = 'belongsToUnit'").select(F.col("entity_id").alias("port"), F.col("target_id").alias("entity_id"))
    edges = ports.join(units, "port").join(m.entity.select("entity_id", "entity_class"), "entity_id")
    edges = edges.select("entity_class", "entity_id", F.lit("hasReferencePort").alias("relation_id"), F.col("port").alias("target_id"), F.lit(0).alias("ord"))
    rest = m.attr.where("attribute_id NOT IN ('is_reversible', 'is_reference_port')")
    return set_relations(set_attributes(m.but(attr=rest), new.select(*m.attr.columns)), edges)


def ensure_targets(m: Model, relation: str, entity_class: str) -> Model:
    """With an entity of the class for each target of a relation that is none yet: carriers, resources, technologies."""
    missing = m.rel.where((F.col("relation_id") == relation) & (F.col("target_id") != "")).select(F.col("target_id").alias("entity_id")).distinct().join(m.entity.select("entity_id"), "entity_id", "left_anti")
    rows = missing.select(F.lit(entity_class).alias("entity_class"), "entity_id", F.lit(False).alias("is_library"), F.lit(0).cast("long").alias("seq"))
    return add_entities(m, rows)


def linked(m: Model, rows: DataFrame, **relations: str) -> Model:
    """Edges from a table with entity_id, one for each named column (relation=column), in place of those that are there:
    `linked(m, t, atNode="bus")`, `linked(m, t, fromNode="a", toNode="b")`, `linked(m, t, hasDemandProfile="profile")`."""
    of = rows.join(m.entity.select("entity_id", "entity_class"), "entity_id")
    for relation, column in relations.items():
        edges = of.where(F.col(column).isNotNull()).select("entity_class", "entity_id", F.lit(relation).alias("relation_id"), F.col(column).alias("target_id"), F.lit(0).alias("ord"))
        m = set_relations(m, edges)
    return m


def with_library_closure(m: Model, library: Model, wanted: DataFrame) -> Model:
    """With the library entities in `wanted` (entity_id) and all that they lead to inside the library, as library rows;
    ids that are there already stay as they are. The frontier is joined again until nothing new is met."""
    there = library.entity.select("entity_id")
    edges = library.rel.join(there.toDF("target_id"), "target_id", "left_semi").select("entity_id", "target_id").distinct()
    seen = cut(wanted.select("entity_id").distinct().join(there, "entity_id", "left_semi"))
    frontier = seen
    while not frontier.isEmpty():
        met = edges.join(frontier, "entity_id", "left_semi").select(F.col("target_id").alias("entity_id")).distinct()
        frontier = cut(met.join(seen, "entity_id", "left_anti"))
        seen = seen.union(frontier)
    new = seen.distinct().join(m.entity.select("entity_id"), "entity_id", "left_anti")
    keep = lambda t: t.join(new, "entity_id", "left_semi").select(*t.columns)
    rows = keep(library.entity).withColumn("is_library", F.lit(True))
    return m.but(entity=m.entity.unionByName(rows.select(*m.entity.columns)), attr=m.attr.unionByName(keep(library.attr)), rel=m.rel.unionByName(keep(library.rel)))
