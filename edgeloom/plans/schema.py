"""Class schemas: parsed and checked on the driver (they are a few kilobytes), then turned into tables.

A source is a mapping with `classes`, `attributes`, `relations` and `units`. A class has `parents` (the first listed
wins over the others, the class itself over all), `abstract` (not inherited), `view_family` (inherited), and items in
`attributes` and `relations`. An item that only overrides required, default or belongsToGroup refers to the registry;
one with other keys is a full definition of its own.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..model import CLASS, CLOSURE, FIELD, Model, local_table

ASSET_ROOT, REPORTS = "EnergyAssetInstance", "reportsOn"
REFERENCE_KEYS = {"id", "required", "default", "belongsToGroup"}


class SchemaError(ValueError):
    pass


def as_list(x: object) -> list:
    return [] if x in (None, "") else list(x) if isinstance(x, (list, tuple)) else [x]


def suggestions(name: str, known: list[str], cutoff: float = 0.6) -> list[str]:
    """Up to three names that look like `name`."""
    return difflib.get_close_matches(name, known, 3, cutoff)


def merged_registry(parts: list[dict], what: str) -> dict:
    """The entries of several registries; the same id with another definition is an error."""
    out: dict = {}
    for part in parts:
        for key, spec in part.items():
            if out.setdefault(key, spec) != spec:
                raise SchemaError(f"{what} {key!r} is defined twice and differently")
    return out


@dataclass
class Schema:
    classes: dict[str, dict]
    attributes: dict[str, dict] = field(default_factory=dict)
    relations: dict[str, dict] = field(default_factory=dict)
    units: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def composed(sources: list[dict]) -> Schema:
        """Several sources in order: registries are merged, later classes may not redefine earlier ones, and
        `augmentations` (class -> items) add registry fields to classes that exist."""
        part = lambda key: merged_registry([s.get(key) or {} for s in sources], key)
        out = Schema(part("classes"), part("attributes"), part("relations"), part("units"))
        for source in sources:
            for name, items in (source.get("augmentations") or {}).items():
                if name not in out.classes:
                    raise SchemaError(f"augmented class {name!r} is unknown; near it: {suggestions(name, list(out.classes))}")
                spec = dict(out.classes[name])
                for kind in ("attributes", "relations"):
                    have = {i["id"]: i for i in map(_item, as_list(spec.get(kind)))}
                    for item in map(_item, as_list(items.get(kind))):
                        if have.setdefault(item["id"], item) != item:
                            raise SchemaError(f"{name}.{item['id']} is augmented against its definition")
                    spec[kind] = list(have.values())
                out.classes[name] = spec
        out.check()
        return out

    def order(self) -> list[str]:
        """Classes after their parents; cycles and unknown parents are errors."""
        done: list[str] = []
        open_: set[str] = set()

        def visit(name: str, child: str) -> None:
            if name in done:
                return
            if name not in self.classes:
                raise SchemaError(f"{child} has the unknown parent {name!r}; near it: {suggestions(name, list(self.classes))}")
            if name in open_:
                raise SchemaError(f"the parents of {name} form a cycle")
            open_.add(name)
            for parent in as_list(self.classes[name].get("parents")):
                visit(parent, name)
            done.append(name)

        for name in self.classes:
            visit(name, name)
        return done

    def check(self) -> None:
        self.order()
        for registry, kind in ((self.attributes, "attributes"), (self.relations, "relations")):
            for name, spec in self.classes.items():
                for item in map(_item, as_list(spec.get(kind))):
                    if set(item) <= REFERENCE_KEYS and item["id"] not in registry:
                        raise SchemaError(f"{name} refers to the unknown {kind[:-1]} {item['id']!r}; near it: {suggestions(item['id'], list(registry))}")
        for name, spec in self.attributes.items():
            for unit in as_list((spec.get("unit") or {}).get("constraints", {}).get("enum") if isinstance(spec.get("unit"), dict) else spec.get("unit")):
                if self.units and unit not in self.units:
                    raise SchemaError(f"attribute {name} has the unregistered unit {unit!r}")

    def fields(self, name: str) -> dict[tuple[str, str], dict]:
        """(kind, id) -> definition, inherited ones included."""
        out: dict = {}
        for parent in reversed(as_list(self.classes[name].get("parents"))):
            out |= self.fields(parent)
        for kind, registry in (("attribute", self.attributes), ("relation", self.relations)):
            for item in map(_item, as_list(self.classes[name].get(kind + "s"))):
                base = registry.get(item["id"], {}) if set(item) <= REFERENCE_KEYS else {}
                out[kind, item["id"]] = base | item
        return out

    def ancestors(self, name: str) -> dict[str, int]:
        """Ancestor -> least depth, the class itself at 0."""
        out, level, depth = {}, [name], 0
        while level:
            for c in level:
                out.setdefault(c, depth)
            level = [p for c in level for p in as_list(self.classes[c].get("parents")) if p not in out]
            depth += 1
        return out

    def view_family(self, name: str) -> str | None:
        found = self.classes[name].get("view_family")
        return found or next((v for p in as_list(self.classes[name].get("parents")) if (v := self.view_family(p))), None)

    def role(self, name: str) -> str:
        """view if it reports on something, asset if it descends from the asset root, else domain."""
        if ("relation", REPORTS) in self.fields(name):
            return "view"
        return "asset" if ASSET_ROOT in self.ancestors(name) else "domain"

    def top_family(self, name: str) -> str:
        """The class below the asset root on the way up over first parents; the class itself outside of it."""
        at = name
        while parents := as_list(self.classes[at].get("parents")):
            if parents[0] == ASSET_ROOT:
                return at
            at = parents[0]
        return name

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """class_def, class_closure, field_def."""
        order = self.order()
        classes = [(c, as_list(self.classes[c].get("parents")), bool(self.classes[c].get("abstract")), self.view_family(c), self.role(c), self.top_family(c)) for c in order]
        closure = [(c, a, d) for c in order for a, d in self.ancestors(c).items()]
        fields = [_field_row(c, kind, key, spec, n) for c in order for n, ((kind, key), spec) in enumerate(self.fields(c).items())]
        return local_table(spark, classes, CLASS), local_table(spark, closure, CLOSURE), local_table(spark, fields, FIELD)

    def dangling_targets(self) -> list[tuple[str, str, str]]:
        """(class, relation, target) whose target class does not exist."""
        return [(c, key, t) for c in self.classes for (kind, key), s in self.fields(c).items() if kind == "relation" for t in as_list(s.get("target", s.get("targets"))) if t not in self.classes]

    def json_schema(self) -> dict:
        """Draft 2020-12 definitions of the classes."""
        kinds = {"decimal": "number", "float": "number", "number": "number", "double": "number", "integer": "integer", "int": "integer", "boolean": "boolean", "bool": "boolean"}
        out = {}
        for c in self.order():
            props, required = {}, []
            for (kind, key), spec in self.fields(c).items():
                row = dict(zip([f.split()[0] for f in FIELD.split(", ")], _field_row(c, kind, key, spec, 0), strict=True))
                if kind == "relation":
                    low, high = cardinality(row["cardinality"])
                    one = {"type": "string"}
                    props[key] = one if high == 1 else {"type": "array", "items": one, "minItems": low} | ({"maxItems": high} if high else {})
                else:
                    props[key] = {"type": kinds.get(row["dtype"].lower(), "string")} | {k: v for k, v in (("minimum", row["minimum"]), ("maximum", row["maximum"]), ("enum", row["enum"] or None), ("pattern", row["pattern"])) if v is not None}
                if row["required"]:
                    required.append(key)
            out[c] = {"type": "object", "properties": props, "required": required}
        return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": out}


def cardinality(text: str) -> tuple[int, int | None]:
    """`1`, `0..1`, `1..*` as least and most (None: no bound)."""
    low, _, high = str(text).partition("..")
    high = high or low
    return (0 if low == "*" else int(low)), None if high == "*" else int(high)


def _item(item: object) -> dict:
    return {"id": item} if isinstance(item, str) else dict(item)


def _field_row(c: str, kind: str, key: str, spec: dict, n: int) -> tuple:
    value = spec.get("value") if isinstance(spec.get("value"), dict) else spec
    limits = value.get("constraints") or {}
    unit = spec.get("unit")
    units = as_list((unit.get("constraints") or {}).get("enum")) if isinstance(unit, dict) else as_list(unit)
    number = lambda x: None if x is None else float(x)
    default = value.get("default", spec.get("default"))
    return (
        c, kind, key, str(value.get("type", "string")), bool(spec.get("required", value.get("required", False))), None if default is None else str(default),
        number(limits.get("minimum")), number(limits.get("maximum")), [str(x) for x in as_list(limits.get("enum"))], limits.get("pattern"), [str(u) for u in units],
        as_list(spec.get("target", spec.get("targets"))), str(spec.get("cardinality", "1")), as_list(spec.get("belongsToGroup")), int(spec.get("order", n)),
    )


def read_sources(paths: list[str]) -> list[dict]:
    """YAML files or folders of them (sorted), each a schema source."""
    out = []
    for path in map(Path, paths):
        for file in sorted(path.rglob("*.yaml")) if path.is_dir() else [path]:
            out.append(yaml.safe_load(file.read_text()) or {})
    return out


def empty_model(spark: SparkSession, schema: Schema) -> Model:
    from ..model import ATTRIBUTE, ENTITY, PROFILE, RELATION

    tables = [spark.createDataFrame([], t) for t in (ENTITY, ATTRIBUTE, RELATION, PROFILE)]
    return Model(*tables, *schema.frames(spark))


def compatible(version: str, wanted: str) -> bool:
    """Same major version, and not older."""
    have, want = ([int(x) for x in v.split(".")] for v in (version, wanted))
    return have[0] == want[0] and have >= want


def canonical_class(name: str, known: list[str]) -> str | None:
    """The class that a name means: as it is written, else without regard to case, dashes and blanks."""
    if name in known:
        return name
    plain = lambda x: x.lower().replace("-", "_").replace(" ", "_")
    return next((k for k in known if plain(k) == plain(name)), None)


def read_manifest(path: str) -> dict:
    """The manifest of a schema: name, version and the stability of its parts; an empty one if there is no file."""
    p = Path(path)
    p = p / "manifest.yaml" if p.is_dir() else p
    return (yaml.safe_load(p.read_text()) or {}) if p.exists() else {}


def stability(manifest: dict, name: str) -> str:
    """The tier of a class or profile in a manifest (`stability`: tier -> names, or name -> tier), else `unknown`."""
    tiers = manifest.get("stability") or {}
    if isinstance(tiers.get(name), str):
        return tiers[name]
    return next((tier for tier, names in tiers.items() if isinstance(names, list) and name in names), "unknown")


def struct_type(schema: Schema, entity_class: str) -> tuple[StructType, dict[str, str]]:
    """The row type of a class's wide table, and for each column with limits a condition that a valid value meets, as
    SQL text: `df.where(checks[c])` on rows of that type."""
    kinds = {"number": DoubleType(), "integer": LongType(), "boolean": BooleanType(), "array": ArrayType(StringType())}
    body = schema.json_schema()["$defs"][entity_class]
    fields, checks = [StructField("entity_id", StringType(), False)], {}
    quoted = lambda v: str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    for name, p in body["properties"].items():
        fields.append(StructField(name, kinds.get(p.get("type"), StringType()), name not in body["required"]))
        tests = [f"`{name}` {sign} {p[key]}" for key, sign in (("minimum", ">="), ("maximum", "<=")) if key in p]
        if "enum" in p:
            tests.append(f"CAST(`{name}` AS STRING) IN ({', '.join(quoted(str(v)) for v in p['enum'])})")
        if "pattern" in p:
            tests.append(f"`{name}` RLIKE {quoted('^(?:' + p['pattern'] + ')$')}")
        if tests:
            checks[name] = f"`{name}` IS NULL OR ({' AND '.join(tests)})"
    return StructType(fields), checks
