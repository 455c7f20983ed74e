"""Rules over a model. Every rule yields rows of one layout: entity_class, entity_id, field_id, rule, detail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import FLAGS, INTEGERS, NUMBERS, coerces, is_numeric, to_double
from ..functions.text import is_set
from ..lineage import cut
from ..model import Model
from ..operators.navigation import effective_values, entities, first_target, targets
from .conditions import Fields, when


class ValidationError(ValueError):
    pass


def _violation(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select("entity_class", "entity_id", "field_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def set_fields(m: Model) -> DataFrame:
    """(entity_id, field_id) of all values and relations that are set."""
    values = m.attr.where(is_set(F.col("value_str"))).select("entity_id", F.col("attribute_id").alias("field_id"))
    return values.union(m.rel.where(is_set(F.col("target_id"))).select("entity_id", "relation_id")).distinct()


def missing_required(m: Model) -> DataFrame:
    """Required fields that are not set. A field of groups is required only of entities that use one of its groups."""
    present = set_fields(m)
    field = m.field_def.select(F.col("class_name").alias("entity_class"), "field_id", "kind", "required", "groups")
    used = m.entity.select("entity_id", "entity_class").join(present, "entity_id").join(F.broadcast(field), ["entity_class", "field_id"])
    active = used.select("entity_id", F.explode("groups").alias("g")).distinct().groupBy("entity_id").agg(F.collect_set("g").alias("active"))
    wanted = m.entity.select("entity_class", "entity_id").join(F.broadcast(field.where("required")), "entity_class").join(active, "entity_id", "left")
    wanted = wanted.where((F.size("groups") == 0) | F.arrays_overlap("groups", F.coalesce("active", F.array().cast("array<string>"))))
    return _violation(wanted.join(present, ["entity_id", "field_id"], "left_anti"), "required", F.concat(F.lit("Missing required "), F.col("kind")))


def _typed(m: Model) -> DataFrame:
    field = m.field_def.where("kind = 'attribute'").withColumnsRenamed({"class_name": "entity_class"}).drop("kind", "required", "default")
    values = m.attr.where(is_set(F.col("value_str"))).select("entity_class", "entity_id", F.col("attribute_id").alias("field_id"), "value_str", "unit")
    return values.join(F.broadcast(field), ["entity_class", "field_id"])


def value_rules() -> dict[str, tuple[Column, Column]]:
    """Rule -> whether a row of _typed breaks it, and the detail."""
    value, x = F.col("value_str"), to_double(F.col("value_str"))
    number = is_numeric(F.col("dtype"))
    same = number & F.exists("enum", lambda e: to_double(e) == x)
    fits = F.regexp(value, F.concat(F.lit(r"\A(?:"), F.col("pattern"), F.lit(r")\z")))
    return {
        "type": (~coerces(value, F.col("dtype")), F.concat_ws(" ", value, F.lit("is no"), F.col("dtype"))),
        "minimum": (number & (x < F.col("minimum")), F.col("minimum")),
        "maximum": (number & (x > F.col("maximum")), F.col("maximum")),
        "enum": ((F.size("enum") > 0) & ~F.array_contains("enum", value) & ~F.coalesce(same, F.lit(False)), F.array_join("enum", ", ")),
        "pattern": (F.col("pattern").isNotNull() & ~fits, F.col("pattern")),
        "unit": ((F.size("units") > 0) & F.col("unit").isNotNull() & ~F.array_contains("units", F.col("unit")), F.col("unit")),
    }


#: What the schema must say for a rule to hold for a field at all; fields without any are not looked at.
LIMITS = {"type": f"lower(dtype) IN {(*NUMBERS, *INTEGERS, *FLAGS)}", "minimum": "minimum IS NOT NULL", "maximum": "maximum IS NOT NULL", "enum": "size(enum) > 0", "pattern": "pattern IS NOT NULL", "unit": "size(units) > 0"}


def wrong_values(m: Model, rules: tuple[str, ...] = ("type", "minimum", "maximum", "enum", "pattern", "unit")) -> DataFrame:
    """Violations of the rules on single values: one pass over the values of the fields that have such a rule, each row
    giving as many as it breaks."""
    limited = " OR ".join(LIMITS[r] for r in rules)
    field = m.field_def.where(f"kind = 'attribute' AND ({limited})")
    named = field.select("class_name", "field_id").collect()  # a part of the schema, which is in the plan
    wanted = F.col("entity_class").isin(*{r["class_name"] for r in named}) & F.col("attribute_id").isin(*{r["field_id"] for r in named})
    rows = _typed(m.but(field_def=field, attr=m.attr.where(wanted if named else F.lit(False))))
    all_ = value_rules()
    broken = F.filter(F.array(*(F.when(all_[r][0], F.struct(F.lit(r).alias("rule"), all_[r][1].cast("string").alias("detail"))) for r in rules)), lambda v: v.isNotNull())
    return rows.select("entity_class", "entity_id", "field_id", F.explode(broken).alias("v")).select("entity_class", "entity_id", "field_id", "v.rule", "v.detail")


def wrong_types(m: Model) -> DataFrame:
    return wrong_values(m, ("type",))


def out_of_range(m: Model) -> DataFrame:
    return wrong_values(m, ("minimum", "maximum"))


def not_in_enum(m: Model) -> DataFrame:
    return wrong_values(m, ("enum",))


def pattern_mismatch(m: Model) -> DataFrame:
    return wrong_values(m, ("pattern",))


def wrong_units(m: Model) -> DataFrame:
    return wrong_values(m, ("unit",))


def dangling(m: Model, known: DataFrame | None = None) -> DataFrame:
    """Targets that are no entity, of the model or of `known` (entity_id), a library that is always there."""
    rows = m.rel.where(is_set(F.col("target_id"))).withColumnRenamed("relation_id", "field_id")
    there = m.entity.select(F.col("entity_id").alias("target_id"))
    there = there if known is None else there.union(known.select("entity_id"))
    return _violation(rows.join(there, "target_id", "left_anti"), "dangling", F.col("target_id"))


def wrong_target_class(m: Model) -> DataFrame:
    """Targets that are of none of the allowed classes or their descendants."""
    field = m.field_def.where("kind = 'relation' and size(targets) > 0").select(F.col("class_name").alias("entity_class"), "field_id", "targets")
    rows = m.rel.withColumnRenamed("relation_id", "field_id").join(F.broadcast(field), ["entity_class", "field_id"])
    above = m.class_closure.groupBy("class_name").agg(F.collect_set("ancestor").alias("above"))
    of = m.entity.select(F.col("entity_id").alias("target_id"), F.col("entity_class").alias("class_name")).join(F.broadcast(above), "class_name")
    return _violation(rows.join(of, "target_id").where(~F.arrays_overlap("targets", "above")), "target_class", F.col("class_name"))


def unknown_fields(m: Model) -> DataFrame:
    known = m.field_def.select(F.col("class_name").alias("entity_class"), "field_id")
    values = m.attr.select("entity_class", "entity_id", F.col("attribute_id").alias("field_id")).union(m.rel.select("entity_class", "entity_id", "relation_id"))
    return _violation(values.distinct().join(F.broadcast(known), ["entity_class", "field_id"], "left_anti"), "unknown", F.lit(None))


def validate(m: Model, unknown: bool = False) -> DataFrame:
    rules = [missing_required, wrong_values, dangling, wrong_target_class, *([unknown_fields] if unknown else [])]
    return reduce(DataFrame.union, [rule(m) for rule in rules])


def messages(violations: DataFrame) -> DataFrame:
    return violations.select(F.format_string("[%s:%s] %s '%s' %s", "entity_class", "entity_id", "rule", "field_id", F.coalesce("detail", F.lit(""))).alias("message"))


def raise_for(violations: DataFrame, most: int = 50) -> None:
    found = messages(violations.orderBy("entity_class", "entity_id", "field_id", "rule").limit(most)).collect()
    if found:
        raise ValidationError("\n".join(r["message"] for r in found))


def load_profile(path: str) -> dict:
    """An analysis profile; a folder's files, sorted, add up to one."""
    p = Path(path)
    files = sorted(p.glob("*.yaml")) if p.is_dir() else [p]
    parts = [yaml.safe_load(f.read_text()) or {} for f in files]
    return {"name": parts[0].get("name", p.stem), "requirements": [r for part in parts for r in part.get("requirements") or []]}


def checked_table(m: Model, entity_class: str) -> tuple[DataFrame, Fields]:
    """A wide table of a class and its descendants: typed attributes, and relations as lists of targets."""
    found = m.field_def.join(m.class_closure.where(F.col("ancestor") == entity_class), "class_name").select("kind", "field_id", "dtype").distinct().collect()
    rows = entities(m, entity_class, derived=True).select("entity_class", "entity_id")
    kinds: dict[str, str] = {}
    for f in found:
        if f["kind"] == "relation":
            rows, kinds[f["field_id"]] = rows.join(targets(m, f["field_id"]).withColumnRenamed("targets", f["field_id"]), "entity_id", "left"), "array<string>"
        else:
            low = f["dtype"].lower()
            kinds[f["field_id"]] = "boolean" if low in ("bool", "boolean") else "double" if low in ("float", "number", "double", "decimal", "int", "integer", "long") else "string"
    values = [k for k, kind in kinds.items() if not kind.startswith("array")]
    cell = lambda a: F.min(F.when(F.col("attribute_id") == a, F.col({"boolean": "value_bool", "double": "value_num", "string": "value_str"}[kinds[a]]))).alias(a)
    if values:
        rows = rows.join(m.attr.groupBy("entity_id").agg(*map(cell, values)), "entity_id", "left")
    return rows, Fields(kinds, frozenset(k for k, kind in kinds.items() if kind.startswith("array")))


#: Fixed names: the relation of an asset that leads to its entity of a family.
LINKS = {"avr": "hasAutomaticVoltageRegulator", "governor": "hasTurbineGovernor", "pss": "hasPowerSystemStabilizer", "dynamics": "usesDynamicModelType"}


def view_map(m: Model) -> DataFrame:
    """class_name of an asset class, view of each class that reports on it or on one that it descends from; a view
    without a target class reports on all asset classes."""
    views = m.field_def.where("kind = 'relation' AND field_id = 'reportsOn'").select(F.col("class_name").alias("view"), "targets")
    below = m.class_closure.select(F.col("ancestor").alias("target"), "class_name")
    named = views.select("view", F.explode("targets").alias("target")).join(F.broadcast(below), "target").select("class_name", "view")
    free = views.where("size(targets) = 0").crossJoin(F.broadcast(m.class_def.where("role = 'asset'").select("class_name"))).select("class_name", "view")  # classes with classes: schema size
    own = m.class_def.where("role = 'asset'").select("class_name")
    return named.union(free).distinct().join(own, "class_name", "left_semi")


def field_families(m: Model, field: str) -> DataFrame:
    """class_name and family of the linked entities (results and controllers) that declare a field; more than one family
    for a class means that a check must name its own."""
    concrete = m.class_def.where("NOT abstract AND view_family IS NOT NULL").select(F.col("class_name").alias("view"), F.col("view_family").alias("family"))
    having = m.field_def.where(F.col("field_id") == field).select(F.col("class_name").alias("view"))
    having = concrete.join(having, "view", "left_semi")
    links = m.spark.createDataFrame(list(LINKS.items()), "family string, field_id string")
    linked = m.field_def.where("kind = 'relation'").select("class_name", "field_id").join(F.broadcast(links), "field_id").select("class_name", "family")
    return view_map(m).join(having, "view").select("class_name", "family").union(linked.join(having.select("family"), "family", "left_semi").select("class_name", "family")).distinct()


def linked_entities(m: Model, family: str) -> DataFrame:
    """entity_id of an asset and linked, its entity of a family: what reports on it, first by load order, else the first
    target of the family's relation. Nothing is created."""
    of = m.class_def.where((F.col("view_family") == family) & ~F.col("abstract")).select(F.col("class_name").alias("entity_class"))
    views = m.rel.where("relation_id = 'reportsOn'").select(F.col("target_id").alias("asset"), "entity_id", "entity_class").join(F.broadcast(of), "entity_class", "left_semi")
    views = views.join(m.entity.select("entity_id", "seq"), "entity_id").groupBy("asset").agg(F.min_by("entity_id", "seq").alias("view")).withColumnRenamed("asset", "entity_id")
    if family not in LINKS:
        return views.select("entity_id", F.col("view").alias("linked"))
    both = views.join(first_target(m, LINKS[family], "forward"), "entity_id", "full_outer")
    return both.select("entity_id", F.coalesce("view", "forward").alias("linked"))


def checked_values(m: Model, rows: DataFrame, name: str, family: str | None) -> DataFrame:
    """`rows` (entity_class, entity_id, ...) with value and problem of a field: of the entity itself, of its technology
    or the schema's default, else of its linked entity of the given family or of the only one that declares the field.
    `problem` says why a field cannot be looked up; there is no value then, so that no other rule is broken."""
    rows = rows.join(effective_values(m, name), "entity_id", "left")
    targets_ = first_target(m, name, "target")
    rows = rows.join(targets_, "entity_id", "left").withColumn("value", F.coalesce("value", "target")).drop("target")
    declared = m.field_def.where(F.col("field_id") == name).select(F.col("class_name").alias("entity_class"), F.lit(True).alias("declared"))
    rows = rows.join(F.broadcast(declared), "entity_class", "left")
    if family is None:
        found = field_families(m, name).groupBy("class_name").agg(F.count("*").alias("families"), F.min("family").alias("family"))
        rows = rows.join(F.broadcast(found.withColumnRenamed("class_name", "entity_class")), "entity_class", "left")
        names = [r["family"] for r in found.where("families = 1").select("family").distinct().collect()]
    else:
        rows, names = rows.withColumn("families", F.lit(1)).withColumn("family", F.lit(family)), [family]
    parts = [linked_entities(m, f).withColumn("family", F.lit(f)) for f in names]
    if parts:
        values = m.attr.where(F.col("attribute_id") == name).select(F.col("entity_id").alias("linked"), F.col("value_str").alias("there"))
        rows = rows.join(reduce(DataFrame.union, parts).join(values, "linked", "left"), ["entity_id", "family"], "left")
    else:
        rows = rows.withColumns({"linked": F.lit(None).cast("string"), "there": F.lit(None).cast("string")})
    use = is_set(F.coalesce("value", F.lit("")))
    own = F.coalesce("declared", F.lit(False)) | use
    problem = F.when(own, None).when(F.col("families") > 1, "ambiguous: name a view_family").when(F.col("families").isNull(), "unknown field").when(F.col("linked").isNull(), F.concat(F.lit("no entity of the family "), F.col("family")))
    return rows.withColumn("problem", problem).withColumn("value", F.when(own, F.col("value")).when(F.col("problem").isNull(), F.col("there"))).drop("declared", "families", "family", "linked", "there")


def validate_for_analysis(m: Model, profile: Mapping) -> DataFrame:
    """Violations of a profile's checks: entity_class, entity_id, field_id, rule, detail, and their order. A field is
    looked for on the entity, then on its technology or the schema's default, then on what is linked with it."""
    out = []
    for n, requirement in enumerate(profile.get("requirements") or []):
        rows, fields = checked_table(m, requirement["entity_class"])
        for k, check in enumerate(requirement.get("checks") or []):
            name = check.get("attribute") or check.get("relation")
            part = rows.where(when(requirement.get("when"), fields) & when(check.get("when"), fields)).select("entity_class", "entity_id")
            part = checked_values(m, part, name, check.get("view_family")).withColumn("field_id", F.lit(name))
            there, required = is_set(F.coalesce("value", F.lit(""))), check.get("required", True)
            lost = F.col("problem").isNotNull() & (F.lit(bool(required)) | ~F.col("problem").startswith("no entity"))
            rules = [("unresolved", lost, F.col("problem"))] + ([("required", ~there & F.col("problem").isNull(), F.lit("not set"))] if required else [])
            limits = check.get("constraints") or {}
            x = to_double(F.col("value"))
            rules += [(r, (x < v) if r == "minimum" else (x > v), F.lit(str(v))) for r in ("minimum", "maximum") if (v := limits.get(r)) is not None]
            if limits.get("enum"):
                rules.append(("enum", F.col("value").isNotNull() & ~F.col("value").isin(*map(str, limits["enum"])), F.lit(str(limits["enum"]))))
            broken = F.filter(F.array(*(F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, bad, detail in rules)), lambda v: v.isNotNull())
            found = part.select("entity_class", "entity_id", "field_id", F.explode(broken).alias("v"))
            out.append(found.select("entity_class", "entity_id", "field_id", "v.rule", "v.detail", F.lit(n * 1000 + k).alias("place")))
    if not out:
        return m.spark.createDataFrame([], "entity_class string, entity_id string, field_id string, rule string, detail string, place int")
    return reduce(DataFrame.union, out)


def unused_fields(m: Model) -> DataFrame:
    """(kind, field_id) of the schema that no entity of the model sets."""
    used = set_fields(m).select("field_id").distinct()
    return m.field_def.select("kind", "field_id").distinct().join(used, "field_id", "left_anti").select("kind", "field_id")


def used_fields(m: Model) -> DataFrame:
    """(kind, class_name, field_id, n) of the fields that entities set, and how many of each class do. Counts only: what
    follows works on rows of the size of the schema."""
    values = m.attr.where(is_set(F.col("value_str"))).select(F.lit("attribute").alias("kind"), F.col("entity_class").alias("class_name"), F.col("attribute_id").alias("field_id"), "entity_id")
    edges = m.rel.where(is_set(F.col("target_id"))).select(F.lit("relation").alias("kind"), F.col("entity_class").alias("class_name"), F.col("relation_id").alias("field_id"), "entity_id")
    return values.union(edges).groupBy("kind", "class_name", "field_id").agg(F.count_distinct("entity_id").alias("n"))


def unused_classes(m: Model) -> DataFrame:
    """class_name of the classes that are not abstract and have no entity of their own."""
    used = m.entity.select(F.col("entity_class").alias("class_name")).distinct()
    return m.class_def.where(~F.col("abstract")).join(used, "class_name", "left_anti").select("class_name")


def audit(m: Model, stable: Sequence[str] = ()) -> DataFrame:
    """What the schema has and the model does not need: finding, class_name, field_id, used_by.

    `dead attribute`, `dead relation`: fields that no entity sets (class_name is null). `orphan class`: one that is not
    abstract and has no entity; `unused stable class` as well, where it is one of `stable`. `single descendant`: a relation
    that a class declares, but that is used by the entities of one of its descendants only. A class declares a field if
    none above it has the field. An empty model leaves every field dead and every class an orphan.
    """
    used = cut(used_fields(m))
    text = lambda name: F.lit(None).cast("string").alias(name)
    dead = m.field_def.select("kind", "field_id").distinct().join(F.broadcast(used), ["kind", "field_id"], "left_anti")
    dead = dead.select(F.concat(F.lit("dead "), "kind").alias("finding"), text("class_name"), "field_id", text("used_by"))
    orphans = unused_classes(m)
    kept = orphans.where(F.col("class_name").isin(*stable)) if stable else orphans.limit(0)
    of_classes = [rows.select(F.lit(name).alias("finding"), "class_name", text("field_id"), text("used_by")) for name, rows in (("orphan class", orphans), ("unused stable class", kept))]
    relation = m.field_def.where("kind = 'relation'").select("class_name", "field_id")
    below = m.class_closure.select("class_name", "ancestor", "depth")
    inherited = relation.join(F.broadcast(below.where("depth > 0")), "class_name").join(relation.withColumnRenamed("class_name", "ancestor"), ["ancestor", "field_id"]).select("class_name", "field_id")
    declared = relation.join(inherited, ["class_name", "field_id"], "left_anti").withColumnRenamed("class_name", "ancestor")
    uses = declared.join(F.broadcast(used.where("kind = 'relation'").select("field_id", F.col("class_name").alias("used_by"))), "field_id")
    uses = uses.join(F.broadcast(below.withColumnRenamed("class_name", "used_by")), ["used_by", "ancestor"], "left")
    single = uses.groupBy("ancestor", "field_id").agg(F.min("used_by").alias("used_by"), F.count_distinct("used_by").alias("n"), F.min(F.coalesce(F.col("depth") > 0, F.lit(False))).alias("only_below")).where("n = 1 AND only_below")
    single = single.select(F.lit("single descendant").alias("finding"), F.col("ancestor").alias("class_name"), "field_id", "used_by")
    return reduce(DataFrame.union, [dead, *of_classes, single])


def ambiguous_families(m: Model) -> DataFrame:
    """(field_id) of attributes that views of several families declare: a check cannot tell which view it means."""
    rows = m.field_def.where("kind = 'attribute'").join(F.broadcast(m.class_def.where("role = 'view'")), "class_name")
    return rows.groupBy("field_id").agg(F.count_distinct("view_family").alias("n")).where("n > 1").select("field_id")
