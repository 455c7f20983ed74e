"""Models and profiles to files and tables. Frames first; the functions that write take a path."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import FLAGS, INTEGERS, NUMBERS
from ..model import Model
from ..operators.navigation import TECHNOLOGY, first_target, library_scope
from ..plans.schema import Schema, as_list
from . import documents


def scoped(m: Model, library: str = "referenced") -> Model:
    """The model with none, the referenced part, or all of its library."""
    ids = library_scope(m, library)
    cut = lambda t: t.join(ids, "entity_id", "left_semi").select(*t.columns)
    return m.but(entity=cut(m.entity), attr=cut(m.attr), rel=cut(m.rel))


def long_rows(m: Model) -> DataFrame:
    """Eight columns: a row for each value and for each target."""
    null = F.lit(None).cast("string")
    values = m.attr.select("entity_class", "entity_id", "attribute_id", F.col("value_str").alias("attribute_value"), F.col("unit").alias("attribute_unit"), F.col("provenance_ref").alias("attribute_provenance"), null.alias("relation_type"), null.alias("relation_id"))
    edges = m.rel.select("entity_class", "entity_id", null, null, null, null, F.col("relation_id"), F.col("target_id"))
    return values.union(edges)


def narrow_rows(m: Model, placeholders: bool = True) -> DataFrame:
    """entity_class, entity_id, attribute, value, relation; an `__exists__` row for an entity without any."""
    null = F.lit(None).cast("string")
    values = m.attr.select("entity_class", "entity_id", F.col("attribute_id").alias("attribute"), F.col("value_str").alias("value"), null.alias("relation"))
    edges = m.rel.groupBy("entity_class", "entity_id", "relation_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "target_id"))), lambda x: x["target_id"]), ";").alias("value"))
    out = values.union(edges.select("entity_class", "entity_id", null, "value", "relation_id"))
    empty = m.entity.join(out.select("entity_id"), "entity_id", "left_anti").select("entity_class", "entity_id", F.lit("__exists__"), F.lit(""), null)
    return out.union(empty) if placeholders else out


def wide_rows(m: Model, entity_class: str, fields: list[str], meta: bool = False) -> DataFrame:
    """One row for each entity of a class, a column for each field; several targets are joined by `;`."""
    edges = narrow_rows(m, placeholders=False).where("relation is not null").select("entity_id", F.col("relation").alias("field"), "value", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("prov"))
    rows = m.attr.select("entity_id", F.col("attribute_id").alias("field"), F.col("value_str").alias("value"), "unit", F.col("provenance_ref").alias("prov")).union(edges).where(F.col("field").isin(*fields))
    cell = lambda f, c, name: F.min(F.when(F.col("field") == f, F.col(c))).alias(name)
    cells = [x for f in fields for x in [cell(f, "value", f), *([cell(f, "unit", f + "__unit"), cell(f, "prov", f + "__prov")] if meta else [])]]
    return m.entity.where(F.col("entity_class") == entity_class).select("entity_id").join(rows.groupBy("entity_id").agg(*cells), "entity_id", "left")


def tidy_rows(m: Model) -> DataFrame:
    """entity_id, entity_class, view_class, field_type, field_id, value, unit: results stand under what they report on."""
    on = m.rel.where("relation_id = 'reportsOn'").select("entity_id", F.col("target_id").alias("asset"))
    rows = m.attr.select("entity_class", "entity_id", F.lit("attribute").alias("field_type"), F.col("attribute_id").alias("field_id"), F.col("value_str").alias("value"), "unit")
    rows = rows.union(m.rel.where("relation_id <> 'reportsOn'").select("entity_class", "entity_id", F.lit("relation"), "relation_id", "target_id", F.lit(None).cast("string")))
    of = m.entity.select(F.col("entity_id").alias("asset"), F.col("entity_class").alias("asset_class"))
    rows = rows.join(on, "entity_id", "left").join(of, "asset", "left")
    view = F.when(F.col("asset").isNotNull(), F.col("entity_class"))
    return rows.select(F.coalesce("asset", "entity_id").alias("entity_id"), F.coalesce("asset_class", "entity_class").alias("entity_class"), view.alias("view_class"), "field_type", "field_id", "value", "unit")


def entity_bodies(m: Model) -> DataFrame:
    """entity_class, entity_id and a JSON body with its values and relations."""
    values = m.attr.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(F.col("attribute_id").alias("id"), F.col("value_str").alias("value"), "unit", "provenance_ref"))).alias("attributes"))
    edges = m.rel.groupBy("entity_id", "relation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "target_id"))), lambda x: x["target_id"]).alias("target_entity_ids"))
    edges = edges.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(F.col("relation_id").alias("id"), "target_entity_ids"))).alias("relations"))
    rows = m.entity.join(values, "entity_id", "left").join(edges, "entity_id", "left").where("attributes is not null or relations is not null")
    return rows.select("entity_class", "entity_id", F.to_json(F.struct("attributes", "relations")).alias("body"))


def write_json(m: Model, path: str) -> None:
    """One JSON document, written in parts by the tasks."""
    documents.write(documents.json_members(entity_bodies(m)), path, "json")


def write_json_lines(m: Model, folder: str) -> None:
    """A folder of JSON rows (entity_id, body) for each class: the form for models of any size."""
    entity_bodies(m).write.partitionBy("entity_class").mode("overwrite").json(folder)


def write_yaml(m: Model, path: str, version: str | None = None) -> None:
    """One YAML document of flat entities, written in parts by the tasks."""
    documents.write(documents.yaml_members(entity_bodies(m)), path, "yaml", yaml.safe_dump({"_meta": {"schema_version": version}}) if version else "")


def write_csv_by_class(m: Model, folder: str, placeholders: bool = True) -> None:
    narrow_rows(m, placeholders).write.partitionBy("entity_class").mode("overwrite").csv(folder, header=True)


def write_long_csv(m: Model, folder: str) -> None:
    long_rows(m).write.mode("overwrite").csv(folder, header=True)


def write_csv_by_class_with_schema(m: Model, schema: Schema, folder: str) -> None:
    """The narrow files, and a Table Schema `<Class>.schema.json` beside them for each class of the schema."""
    write_csv_by_class(m, folder)
    for c in schema.order():
        Path(folder, f"{c}.schema.json").write_text(json.dumps({"fields": [{"name": n, "type": "string"} for n in ("entity_id", "attribute", "value", "relation")], "class": c, "columns": table_schema(schema, c)["fields"]}, indent=2))


def write_long_csv_with_schema(m: Model, folder: str) -> None:
    """The long file, and the Table Schema of its eight columns."""
    write_long_csv(m, folder)
    fields = [{"name": c, "type": "string", "constraints": {"required": c in ("entity_class", "entity_id")}} for c in long_rows(m).columns]
    Path(folder, "long.schema.json").write_text(json.dumps({"fields": fields}, indent=2))


def write_parquet(m: Model, profiles: DataFrame, path: str) -> None:
    """Long form: a row for each value, for each relation with its targets in order, for each profile's series
    (`__values__`), and for an entity without any (`__exists__`)."""
    kinds = {"attribute": "string", "value": "string", "unit": "string", "provenance_ref": "string", "relation": "string", "targets": "array<string>", "values": "array<double>"}
    row = lambda rows, **cells: rows.select("entity_class", "entity_id", *(cells.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))
    series = profiles.groupBy("profile_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("values"))
    series = series.select(F.lit("Profile").alias("entity_class"), F.col("profile_id").alias("entity_id"), "values")
    edges = m.rel.groupBy("entity_class", "entity_id", "relation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "target_id"))), lambda x: x["target_id"]).alias("targets"))
    values = row(m.attr, attribute=F.col("attribute_id"), value=F.col("value_str"), unit=F.col("unit"), provenance_ref=F.col("provenance_ref"))
    bare = m.entity.join(m.attr.select("entity_id").union(m.rel.select("entity_id")).union(series.select("entity_id")), "entity_id", "left_anti")
    out = values.union(row(edges, relation=F.col("relation_id"), targets=F.col("targets")))
    out = out.union(row(series, attribute=F.lit("__values__"), values=F.col("values"))).union(row(bare, attribute=F.lit("__exists__")))
    out.write.mode("overwrite").parquet(path)


def profiles_wide(profiles: DataFrame, ids: list[str], kind: str = "double") -> DataFrame:
    """timestamp_index and a column for each of the given profiles."""
    cells = [F.min(F.when(F.col("profile_id") == p, F.col("value"))).cast(kind).alias(p) for p in ids]
    return profiles.groupBy(F.col("t").cast("long").alias("timestamp_index")).agg(*cells)


def table_schema(schema: Schema, entity_class: str, classes: set[str] | None = None, abstract: set[str] | None = None) -> dict:
    """The Table Schema of a class's wide table. A relation is a foreign key into the table of its target class, into
    that of all entities of an abstract target, else into the one of all entities."""
    defs, fields = schema.json_schema()["$defs"][entity_class], schema.fields(entity_class)
    keys = {k: as_list(s.get("target", s.get("targets"))) for (kind, k), s in fields.items() if kind == "relation"}
    rows = [{"name": "entity_id", "type": "string", "constraints": {"required": True}}]
    for k, p in defs["properties"].items():
        limits = {n: p[n] for n in ("minimum", "maximum", "enum", "pattern") if n in p} | ({"required": True} if k in defs["required"] else {})
        rows.append({"name": k, "type": "string" if k in keys else p.get("type", "string")} | ({"constraints": limits} if limits else {}))

    def resource(targets: list[str]) -> str:
        one = targets[0] if len(targets) == 1 else None
        name = one if one in (classes or ()) else "All" + one.replace(".", "") if one in (abstract or ()) else "AllEntities"
        return kebab_name(name)

    return {"fields": rows, "primaryKey": ["entity_id"], "foreignKeys": [{"fields": [k], "reference": {"resource": resource(t), "fields": ["entity_id"]}} for k, t in keys.items()]}


#: Relations that an export takes from an asset's technology where the asset has none.
FROM_TYPE = ("hasInputCarrier", "hasOutputCarrier", "storesCarrier")


def with_type_relations(m: Model) -> Model:
    """The relations in FROM_TYPE of an entity's technology, for entities that do not have them."""
    known = m.field_def.where((F.col("kind") == "relation") & F.col("field_id").isin(*FROM_TYPE)).select(F.col("class_name").alias("entity_class"), F.col("field_id").alias("relation_id"))
    technology = first_target(m, TECHNOLOGY, "technology").join(m.entity.select("entity_id", "entity_class"), "entity_id")
    of_type = m.rel.where(F.col("relation_id").isin(*FROM_TYPE)).select(F.col("entity_id").alias("technology"), "relation_id", "target_id", "ord")
    new = technology.join(of_type, "technology").join(F.broadcast(known), ["entity_class", "relation_id"], "left_semi")
    own = m.rel.where(F.col("target_id") != "").select("entity_id", "relation_id").distinct()
    return m.but(rel=m.rel.unionByName(new.join(own, ["entity_id", "relation_id"], "left_anti").select(*m.rel.columns)))


def union_tables(m: Model) -> DataFrame:
    """all_class, entity_id, entity_class, name: for each abstract class that a relation targets, its entities of any
    concrete class, which foreign keys can refer to."""
    abstract = m.class_def.where("abstract").select(F.col("class_name").alias("all_class"))
    targets = m.field_def.where("kind = 'relation'").select(F.explode("targets").alias("all_class")).distinct().join(abstract, "all_class", "left_semi")
    concrete = m.class_closure.join(m.class_def.where("NOT abstract"), "class_name", "left_semi").select(F.col("ancestor").alias("all_class"), F.col("class_name").alias("entity_class"))
    wanted = concrete.join(F.broadcast(targets), "all_class", "left_semi")
    names = m.attr.where("attribute_id = 'name'").select("entity_id", F.col("value_str").alias("name"))
    rows = m.entity.select("entity_class", "entity_id").join(F.broadcast(wanted), "entity_class").join(names, "entity_id", "left")
    return rows.select("all_class", "entity_id", "entity_class", F.coalesce("name", F.lit("")).alias("name"))


def all_entities(m: Model) -> DataFrame:
    """entity_id, entity_class, name of everything."""
    names = m.attr.where("attribute_id = 'name'").select("entity_id", F.col("value_str").alias("name"))
    return m.entity.select("entity_id", "entity_class").join(names, "entity_id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def _resource(name: str, schema: dict) -> dict:
    return {"name": kebab_name(name), "title": name, "path": f"{name}.csv", "type": "table", "format": "csv", "mediatype": "text/csv", "encoding": "utf-8", "schema": schema}


def kebab_name(name: str) -> str:
    return "".join("-" + c.lower() if c.isupper() and k else c.lower() for k, c in enumerate(name.replace(".", "")))


def write_datapackage(m: Model, schema: Schema, folder: str, library: str = "all") -> None:
    """A table for each class with entities, one of all entities, one for each abstract class that relations target, and
    the descriptor. A table is a folder `<Class>.csv` of CSV files that Spark writes, as large as it may be."""
    m = with_type_relations(m if library == "all" else scoped(m, library))
    out = Path(folder.removeprefix("file://"))
    out.mkdir(parents=True, exist_ok=True)
    write = lambda rows, name: rows.write.mode("overwrite").option("escape", '"').csv(f"{folder}/{name}.csv", header=True)
    classes = sorted(r["entity_class"] for r in m.entity.select("entity_class").distinct().collect())
    unions = union_tables(m)
    abstract = sorted(r["all_class"] for r in unions.select("all_class").distinct().collect())
    plain = {"fields": [{"name": c, "type": "string", "constraints": {"required": c != "name"}} for c in ("entity_id", "entity_class", "name")], "primaryKey": ["entity_id"]}
    resources = []
    for c in classes:
        write(wide_rows(m, c, [k for _, k in schema.fields(c)]), c)
        resources.append(_resource(c, table_schema(schema, c, set(classes), set(abstract))))
    write(all_entities(m), "AllEntities")
    resources.append(_resource("AllEntities", plain))
    for c in abstract:
        name = "All" + c.replace(".", "")
        write(unions.where(F.col("all_class") == c).drop("all_class"), name)
        resources.append(_resource(name, plain))
    (out / "datapackage.json").write_text(json.dumps({"name": "model", "resources": resources}, indent=2))


def turtle(schema: Schema, namespace: str) -> str:
    """Classes and fields as OWL in Turtle."""
    text = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    lines = [f"@prefix : <{namespace}> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", ""]
    for c in schema.order():
        lines.append(f":{c} a owl:Class ; rdfs:label {text(c)} .")
        lines += [f":{c} rdfs:subClassOf :{p} ." for p in schema.classes[c].get("parents") or []]
    kinds = {"double": "decimal", "integer": "integer", "boolean": "boolean", "string": "string"}
    for name, spec in schema.attributes.items():
        value = spec.get("value") if isinstance(spec.get("value"), dict) else spec
        low = str(value.get("type", "string")).lower()
        kind = "double" if low in NUMBERS else "integer" if low in INTEGERS else "boolean" if low in FLAGS else "string"
        unit = spec.get("unit")
        units = as_list((unit.get("constraints") or {}).get("enum")) if isinstance(unit, dict) else as_list(unit)
        notes = "".join(f" ; rdfs:comment {text('unit: ' + str(u))}" for u in units)
        lines.append(f":{name} a owl:DatatypeProperty ; rdfs:label {text(name)} ; rdfs:range xsd:{kinds[kind]}{notes} .")
    for name, spec in schema.relations.items():
        ranges = "".join(f" ; rdfs:range :{t}" for t in as_list(spec.get("target", spec.get("targets"))))
        lines.append(f":{name} a owl:ObjectProperty ; rdfs:label {text(name)}{ranges} .")
    return "\n".join(lines) + "\n"


def matpower_text(case: dict[str, list[list[float]]], name: str = "case", base_mva: float = 100.0) -> str:
    """A case file of small matrices."""
    number = lambda x: f"{x:.10g}"
    body = [f"function mpc = {name}", "mpc.version = '2';", f"mpc.baseMVA = {number(base_mva)};"]
    for matrix, rows in case.items():
        body += [f"mpc.{matrix} = [", *("\t" + "\t".join(map(number, r)) + ";" for r in rows), "];"]
    return "\n".join(body) + "\n"


def bus_loads(loads: DataFrame, shunts: DataFrame, buses: DataFrame) -> DataFrame:
    """Pd, Qd, Gs, Bs of each bus, 0 where nothing stands there."""
    total = lambda c: F.sum(c).alias(c)
    out = buses.join(loads.groupBy("bus").agg(total("pd"), total("qd")), "bus", "left").join(shunts.groupBy("bus").agg(total("gs"), total("bs")), "bus", "left")
    return out.fillna(0.0, ["pd", "qd", "gs", "bs"])


def first_set(*columns: Column) -> Column:
    """The first value that is not null or empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))
