"""Models in hierarchical YAML: fields in groups, results nested under the asset that they report on.

    Class:
      id:
        attributes: {group: {name: {value, unit, provenance_ref}}}
        relations: {group: {name: {target_entity_ids: [...]}}}
        representations: {ResultClass: {attributes, relations}}

Fields may also stand in a mapping without groups or in a list of records with an id. A field in several groups counts
once. A file holds one document, which tasks read and write in parts (`documents.py`).
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import underscored
from ..lineage import cut
from ..model import Model
from ..plans.schema import compatible
from . import documents
from .readers import read_rows
from .writers import scoped

META, GROUP = "_meta", "core"
REPORTS = "reportsOn"


def _groups(m: Model, kind: str, name: str) -> DataFrame:
    rows = m.field_def.where(F.col("kind") == kind).select(F.col("class_name").alias("entity_class"), F.col("field_id").alias(name), F.explode_outer("groups").alias("g"))
    return rows.withColumn("g", F.coalesce("g", F.lit(GROUP)))


def bodies(m: Model) -> DataFrame:
    """entity_class, entity_id, body (JSON) and reported_on: the id of the asset, for what is nested under one."""
    value = F.struct(F.col("value_str").alias("value"), "unit", "provenance_ref")
    values = m.attr.join(F.broadcast(_groups(m, "attribute", "attribute_id")), ["entity_class", "attribute_id"])
    by_group = lambda rows, name, cell: rows.groupBy("entity_id", "g").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, cell.alias("cell"))))).alias("fields"))
    in_groups = lambda rows, name: rows.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("g", F.to_json("fields").alias("f"))), asc=True)).alias(name))
    attributes = in_groups(by_group(values.dropDuplicates(["entity_id", "attribute_id", "g"]), "attribute_id", F.to_json(value)), "attributes")
    edges = m.rel.where((F.col("target_id") != "") & (F.col("relation_id") != REPORTS)).groupBy("entity_class", "entity_id", "relation_id")
    edges = edges.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "target_id"))), lambda x: x["target_id"]).alias("target_entity_ids"))
    edges = edges.join(F.broadcast(_groups(m, "relation", "relation_id")), ["entity_class", "relation_id"])
    relations = in_groups(by_group(edges, "relation_id", F.to_json(F.struct("target_entity_ids"))), "relations")
    on = m.rel.where(F.col("relation_id") == REPORTS).groupBy("entity_id").agg(F.min_by("target_id", "ord").alias("reported_on"))
    rows = m.entity.join(attributes, "entity_id", "left").join(relations, "entity_id", "left").join(on, "entity_id", "left")
    return rows.select("entity_class", "entity_id", "reported_on", "attributes", "relations")


def nested_bodies(m: Model) -> DataFrame:
    """entity_class, entity_id, body: representations stand in the body of what they report on."""
    rows = bodies(m)
    body = F.struct("attributes", "relations")
    views = rows.where("reported_on IS NOT NULL").select(F.col("reported_on").alias("entity_id"), F.struct("entity_class", body.alias("body")).alias("view"))
    nested = views.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(F.col("view.entity_class").alias("name"), F.to_json("view.body").alias("body")))).alias("views"))
    flat = rows.where("reported_on IS NULL").join(nested, "entity_id", "left")
    return flat.select("entity_class", "entity_id", F.to_json(F.struct("attributes", "relations", "views")).alias("body"))


def _block(body: str) -> dict:
    """What is written of an entity: groups and fields without nulls, results under their classes."""
    plain = lambda groups: {g: {k: {n: v for n, v in json.loads(x).items() if v is not None} for k, x in json.loads(f).items()} for g, f in (groups or {}).items()}
    parts = lambda b: {k: plain(b[k]) for k in ("attributes", "relations") if b.get(k)}
    block = json.loads(body)
    out = parts(block)
    if block.get("views"):
        out["representations"] = {v["name"]: parts(json.loads(v["body"])) for v in block["views"]}
    return out


def write_hierarchical_yaml(m: Model, path: str, library: str = "referenced", version: str | None = None) -> None:
    """One YAML file, written in parts by the tasks."""
    documents.write(documents.yaml_members(nested_bodies(scoped(m, library)), _block), path, "yaml", yaml.safe_dump({META: {"schema_version": version}}) if version else "")


def _records(block: object, known: set[str], wrap: str) -> dict[str, dict]:
    """Field -> record of a block in any of its three forms."""
    items: list[tuple[str, object]] = []
    if isinstance(block, dict):
        grouped = bool(block) and all(isinstance(v, dict) and k not in known for k, v in block.items())
        items = [x for v in block.values() for x in v.items()] if grouped else list(block.items())
    elif isinstance(block, list):
        items = [(r.get("id") or r.get("name"), {k: v for k, v in r.items() if k not in ("id", "name")}) for r in block if isinstance(r, dict)]
    out: dict[str, dict] = {}
    for name, value in items:
        if name and value not in ("", None):
            out.setdefault(str(name), value if isinstance(value, dict) else {wrap: value})
    return out


def _fields(known: dict[str, tuple[set[str], set[str]]]) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """(class, id, field, kind, value, unit, provenance, ord, seq) of bodies; a row without a field for each entity."""

    def entity(seq: int, c: str, id_: str, block: dict) -> Iterator[tuple]:
        attributes, relations = known.get(c, (set(), set()))
        yield c, id_, None, "entity", None, None, None, 0, seq
        for name, r in _records(block.get("attributes"), attributes, "value").items():
            v = r.get("value")
            if v not in ("", None):
                yield c, id_, name, "attribute", json.dumps(v) if isinstance(v, (dict, list)) else str(v).lower() if isinstance(v, bool) else str(v), _text(r.get("unit")), _text(r.get("provenance_ref")), 0, seq
        for name, r in _records(block.get("relations"), relations, "target_entity_ids").items():
            found = r.get("target_entity_ids", r.get("target"))
            for n, t in enumerate(found if isinstance(found, list) else [found]):
                if t not in ("", None):
                    yield c, id_, name, "relation", str(t), None, None, n, seq

    def rows(bodies: Iterator[tuple]) -> Iterator[tuple]:
        for seq, c, id_, body in bodies:
            block = json.loads(body)
            yield from entity(seq, c, id_, block)
            for view, nested in (block.get("representations") or {}).items():
                yield view, id_, None, "view", None, None, None, 0, seq
                yield from ((*r[:3], "view " + r[3], *r[4:]) for r in entity(seq, view, id_, nested or {}))

    return rows


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def read_hierarchical_yaml(m: Model, path: str, library: bool = False, version: str | None = None) -> Model:
    """The model of a file, read in splits. Ids of nested results are `<class_in_snake_case>.<asset>`, and their reportsOn
    edge is put back. A file of another major version than `version` gives a warning."""
    return read_document(m, path, "yaml", library, version)


def read_document(m: Model, path: str, form: str, library: bool = False, version: str | None = None) -> Model:
    """As `read_hierarchical_yaml`, of a document in YAML or JSON. Fields may stand in any of the three forms."""
    found = cut(documents.entities(m.spark, path, form))
    if version:
        notes = found.where(F.col("entity_class").startswith("_") & F.col("entity_class").endswith(META) & (F.col("entity_id") == "schema_version")).first()
        written = notes and json.loads(notes["body"]).get("value")
        if written and not compatible(str(written), str(version).split(".")[0] + ".0"):
            warnings.warn(f"{path} was written for schema version {written}, not {version}", stacklevel=3)
    known: dict[str, tuple[set[str], set[str]]] = {}
    for r in m.field_def.select("class_name", "kind", "field_id").collect():
        known.setdefault(r["class_name"], (set(), set()))[r["kind"] == "relation"].add(r["field_id"])
    members = found.where(~F.col("entity_class").startswith("_")).select("seq", "entity_class", "entity_id", "body")
    rows = documents.mapped_rows(members, _fields(known), "entity_class string, entity_id string, field string, kind string, value string, unit string, provenance_ref string, ord int, seq long")
    nested = F.col("kind").startswith("view")
    snake = underscored(F.regexp_replace(F.regexp_replace("entity_class", "([a-z0-9])([A-Z])", "$1_$2"), r"\.", "_"))
    rows = rows.withColumn("asset", F.when(nested, F.col("entity_id"))).withColumn("entity_id", F.when(nested, F.concat(snake, F.lit("."), F.col("entity_id"))).otherwise(F.col("entity_id")))
    kind = F.regexp_replace("kind", "^view ", "")
    values = rows.where(kind == "attribute").select("entity_class", "entity_id", F.col("field").alias("attribute_id"), F.col("value").alias("value_str"), "unit", "provenance_ref")
    edges = rows.where(kind == "relation").select("entity_class", "entity_id", F.col("field").alias("relation_id"), F.col("value").alias("target_id"), "ord")
    back = rows.where("kind = 'view'").select("entity_class", "entity_id", F.lit(REPORTS).alias("relation_id"), F.col("asset").alias("target_id"), F.lit(0).alias("ord"))
    return read_rows(m, rows.select("entity_class", "entity_id", "seq"), values, edges.union(back), library)
