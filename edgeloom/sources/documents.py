"""Documents {Class: {id: body}} or {Class: [{id, ...}]} in YAML or JSON, read and written in many tasks.

Spark reads a file in splits: YAML by lines, JSON by closing braces. A first pass sums up each split (which classes begin
in it and how deep it is indented; how many quotes and brackets it holds), and the driver carries these few figures from
split to split. A second pass cuts each split at the borders of entities. Only the two ends of a split, which may belong
to an entity that lies across it, are brought together in a shuffle. On the driver there is a row for each class and each
split, never one for an entity; one entity's body is parsed in one task.

Written documents are sorted by class and id over all tasks, and their parts are joined in order.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..lineage import cut, shared_folder

LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
DUMPER = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
#: Bytes of a file are numbered below this shift, files above it.
FILE = 46
BATCH = 512
#: A model has as many top-level keys as its schema has classes.
MAX_CLASSES = 100_000

YAML_SUMMARY = "at long, place long, name string, whole boolean, indent int"
JSON_SUMMARY = "at long, quotes int, outside long, inside long"
PIECE = "at long, place long, part string, depth int, text string"
ENTITY_BODY = "place long, opened string, entity_id string, body string"


def _mapped(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]], schema: str) -> DataFrame:
    """`rows` of a task's batches as a DataFrame, in small batches."""
    kind = pa.schema([(f.name, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}.get(f.dataType.typeName().replace("integer", "int"), pa.string())) for f in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for r in rows(batches):
            held.append(r)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)

    return df.mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))


def mapped_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """`rows` of the rows of a task, as tuples."""
    return _mapped(df, lambda batches: rows(_rows(batches)), schema)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[str]]]:
    """Where each split of a task begins, and its rows in order."""
    for at, group in groupby(_rows(batches), key=itemgetter(0)):
        yield at, (v or "" for _, v in group)


def _text(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    """at (file number and first byte of the split) and value, in the order of the file within a split."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path)
    paths = sorted(re.sub("^file:/+", "file:/", f) for f in rows.inputFiles())
    files = F.broadcast(spark.createDataFrame(list(enumerate(paths)), "file_no long, file string"))
    named = rows.select("value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return named.join(files, "file").select((F.shiftleft("file_no", FILE) + F.col("start")).alias("at"), "value")


# YAML: regions of classes, members at the least indent of a region

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s].*?)\s*:(?=\s|$)\s*(.*)$""")


def _indent(line: str) -> int | None:
    """The indent of a line with content; None for blank lines, comments and marks of a document."""
    body = line.lstrip(" ")
    if not body.strip() or body[0] in "#%" or line[:3] in ("---", "..."):
        return None
    return len(line) - len(body)


def _is_top(line: str) -> bool:
    return _indent(line) == 0 and not (line == "-" or line.startswith("- "))


def _opening(line: str) -> tuple[str | None, bool]:
    """The class that a line opens, and whether its members stand in flow form, which is kept whole."""
    line = line.lstrip("\ufeff")
    found = _KEY.match(line)
    if line[:1] in ("{", "[") or found is None:
        return None, True
    rest = found.group(2)
    return str(yaml.load(found.group(1), LOADER)), bool(rest) and rest[0] not in "#&!"


def _yaml_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for at, lines in _splits(batches):
        region: tuple = (at, None, None, False)
        least: int | None = None
        for n, line in enumerate(lines):
            if _is_top(line):
                yield (*region, least)
                region, least = (at, at + n, *_opening(line)), None
            elif (i := _indent(line)) is not None:
                least = i if least is None else min(least, i)
        yield (*region, least)


def _yaml_regions(rows: DataFrame) -> list[tuple[int, str | None, int]]:
    """(place, class, indent of its members or -1) in order."""
    out: list[list] = []
    for r in sorted(_mapped(rows, _yaml_summary, YAML_SUMMARY).collect(), key=lambda r: (r["at"], -1 if r["place"] is None else r["place"])):
        if r["place"] is not None:
            out.append([r["place"], r["name"], r["whole"], None])
        if out and r["indent"] is not None:
            out[-1][3] = r["indent"] if out[-1][3] is None else min(out[-1][3], r["indent"])
    return [(place, name, -1 if whole or least is None else least) for place, name, whole, least in out]


def _yaml_pieces(regions: list[tuple[int, str | None, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    places = [r[0] for r in regions]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for at, lines in _splits(batches):
            k = bisect_left(places, at) - 1
            start: int | None = None
            held: list[str] = []
            for n, line in enumerate(lines):
                opens = k + 1 < len(places) and places[k + 1] == at + n
                k += opens
                if opens or k >= 0 and _indent(line) == regions[k][2] and not _is_top(line):
                    if start is not None or held:
                        yield at, start if start is not None else at, None if start is not None else "head", 0, "\n".join(held)
                    start, held = at + n, []
                held.append(line)
            if held:
                yield at, start if start is not None else at, "tail" if start is not None else "head", 0, "\n".join(held)

    return rows


def _listed(members: object) -> Iterator[tuple[str, dict]]:
    if isinstance(members, dict):
        yield from ((str(k), v if isinstance(v, dict) else {}) for k, v in members.items())
    elif isinstance(members, list):
        yield from ((str(e.get("id")), {k: v for k, v in e.items() if k != "id"}) for e in members if isinstance(e, dict))


def _yaml_entities(regions: list[tuple[int, str | None, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    places = [r[0] for r in regions]
    tell = lambda block: json.dumps(block, default=str, ensure_ascii=False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for place, text in _rows(batches):
            k = bisect_right(places, place) - 1
            if k < 0:
                continue
            found = yaml.load(text.lstrip("\ufeff") + "\n", LOADER)
            if places[k] != place:
                name = regions[k][1]
                yield from ((place, name, i, tell(b)) for i, b in _members(name, found))
            elif isinstance(found, dict):
                yield from ((place, str(c), i, tell(b)) for c, members in found.items() for i, b in _members(str(c), members))

    return rows


def _members(name: str | None, found: object) -> Iterator[tuple[str, dict]]:
    """Entities of a class; for keys such as `_meta`, the value itself under its name."""
    if name and name.startswith("_") and isinstance(found, dict):
        yield from ((str(k), {"value": v}) for k, v in found.items())
    else:
        yield from _listed(found)


# JSON: rows end at closing braces, the state at a split is a prefix sum

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_STRING = r'"(?:[^"\\]|\\.)*"'
_FIELD = re.compile(rf"\s*({_STRING})\s*:\s*")
_SCALAR = re.compile(rf"({_STRING}|[^\s,{{}}\[\]\"]+)")


def _json_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """How a split changes the state, for a start outside of a string and for one inside."""
    for at, values in _splits(batches):
        odd, depth = 0, [0, 0]
        for value in values:
            parts = _ESCAPED.sub("", value).split('"')
            for n, p in enumerate(parts):
                depth[(n + odd) % 2] += p.count("{") + p.count("[") - p.count("]")
            odd = (odd + len(parts) - 1) % 2
            depth[odd] -= 1
        yield at, odd, depth[0], depth[1]


def _json_starts(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Split -> (inside a string, depth) where it begins; each file begins anew."""
    out: dict[int, tuple[int, int]] = {}
    inside, depth, file = 0, 0, None
    for r in sorted(_mapped(rows, _json_summary, JSON_SUMMARY).collect(), key=itemgetter("at")):
        if r["at"] >> FILE != file:
            inside, depth, file = 0, 0, r["at"] >> FILE
        out[r["at"]] = (inside, depth)
        depth += r["inside"] if inside else r["outside"]
        inside = (inside + r["quotes"]) % 2
    return out


def _json_pieces(starts: dict[int, tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for at, values in _splits(batches):
            inside, depth = starts[at]
            start, before, held = at, depth, []
            part: str | None = "head"
            n = -1
            for n, value in enumerate(values):
                parts = _ESCAPED.sub("", value).split('"')
                depth += sum(p.count("{") + p.count("[") - p.count("]") for p in parts[inside::2])
                inside = (inside + len(parts) - 1) % 2
                held.append(value + "}")
                if not inside:
                    depth -= 1
                    if depth <= 2:
                        yield at, start, part, before, "".join(held)
                        start, before, held, part = at + n + 1, depth, [], None
            yield at, start, part or "tail", before, "".join(held)

    return rows


def _json_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Entities of texts that end with one: what stands before it may close a class and open others."""
    for place, depth, text in _rows(batches):
        rest = text.lstrip("\ufeff \t\r\n,")
        if depth <= 0 and rest.startswith("{"):
            depth, rest = 1, rest[1:]
        opened = None
        while rest:
            if rest[0] in "\t\r\n ,":
                rest = rest.lstrip("\t\r\n ,")
            elif rest[0] in "]}":
                depth, rest = min(depth, 2) - 1, rest[1:]
            elif found := _FIELD.match(rest):
                name, rest = json.loads(found.group(1)), rest[found.end() :]
                if rest[:1] in ("{", "[") and depth <= 1:
                    opened, depth, rest = name, 2, rest[1:]
                    yield place, opened, None, None
                elif rest[:1] == "{":
                    body, end = json.JSONDecoder().raw_decode(rest)
                    yield place, opened, name, json.dumps(body, ensure_ascii=False)
                    rest = rest[end:]
                elif scalar := _SCALAR.match(rest):
                    if depth >= 2:
                        yield place, opened, name, json.dumps({"value": json.loads(scalar.group(1))})
                    rest = rest[scalar.end() :]
                else:
                    _, end = json.JSONDecoder().raw_decode(rest)
                    rest = rest[end:]
            elif rest[0] == "{" and depth >= 2:
                body, end = json.JSONDecoder().raw_decode(rest)
                yield place, opened, str(body.pop("id", None)), json.dumps(body, ensure_ascii=False)
                rest = rest[end:]
            else:
                raise ValueError(f"no document of classes: {rest[:40]!r}")


# both


def _whole(pieces: DataFrame, by_file: bool, glue: str) -> DataFrame:
    """(place, depth, text) of pieces, the ends of splits joined. There are two ends at most for each split."""
    file = F.shiftright("at", FILE) if by_file else F.lit(0)
    order = Window.partitionBy(file).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    ends = pieces.where("part IS NOT NULL")
    tails = ends.groupBy("at").agg(F.max(F.when(F.col("part") == "tail", F.col("place"))).alias("tail"))
    owner = tails.select("at", F.coalesce(F.last("tail", ignorenulls=True).over(order), F.min("at").over(Window.partitionBy(file))).alias("before"))
    owned = ends.join(owner, "at").withColumn("owner", F.when(F.col("part") == "tail", F.col("place")).otherwise(F.col("before")))
    joined = owned.groupBy("owner").agg(F.min_by("depth", "place").alias("depth"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), glue).alias("text"))
    return pieces.where("part IS NULL").select("place", "depth", "text").union(joined.select(F.col("owner").alias("place"), "depth", "text"))


def entities(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """seq, entity_class, entity_id and body (JSON) of a document; `form` is yaml or json, by default that of the suffix.

    A folder is read as its files in the order of their names. YAML is cut where classes and members stand in block form,
    and a class in flow form is one piece; an alias must stand in the entity of its anchor, and a file that is all in flow
    form must be JSON. Several entities of one piece
    share their seq."""
    form = form or ("json" if path.rstrip("/").endswith(".json") else "yaml")
    if form == "yaml":
        rows = _text(spark, path, None)
        regions = _yaml_regions(rows)
        _bounded(len(regions))
        if regions and regions[0][1] is None:
            return entities(spark, path, "json")
        pieces = cut(_mapped(rows, _yaml_pieces(regions), PIECE))
        found = _mapped(_whole(pieces, False, "\n").select("place", "text"), _yaml_entities(regions), ENTITY_BODY)
        return found.select(F.col("place").alias("seq"), F.col("opened").alias("entity_class"), "entity_id", "body")
    rows = _text(spark, path, "}")
    pieces = cut(_mapped(rows, _json_pieces(_json_starts(rows)), PIECE))
    found = cut(_mapped(_whole(pieces, True, "").select("place", "depth", "text"), _json_entities, ENTITY_BODY))
    opened = sorted((r["place"], r["opened"]) for r in found.where("opened IS NOT NULL AND entity_id IS NULL").groupBy("place").agg(F.last("opened").alias("opened")).collect())
    _bounded(len(opened))
    members = _mapped(found.where("entity_id IS NOT NULL"), _in_classes(opened), ENTITY_BODY)
    return members.select(F.col("place").alias("seq"), F.col("opened").alias("entity_class"), "entity_id", "body")


def _in_classes(opened: list[tuple[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """Rows with the class that was opened last before them, where their own piece opens none."""
    places = [p for p, _ in opened]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for place, own, id_, body in _rows(batches):
            k = bisect_right(places, place) - 1
            if own is not None or k >= 0:
                yield place, own if own is not None else opened[k][1], id_, body

    return rows


def _bounded(n: int) -> None:
    if n > MAX_CLASSES:
        raise ValueError(f"{n} top-level keys: this is no document of classes")


# writing


def yaml_members(rows: DataFrame, parsed: Callable[[str], dict] = json.loads) -> DataFrame:
    """entity_class, entity_id, text: a body in JSON (`parsed` to what is written) as a member of its class in YAML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c, id_, body in _rows(batches):
            text = yaml.dump({id_: parsed(body)}, Dumper=DUMPER, allow_unicode=True, sort_keys=False)
            yield c, id_, "\n".join("  " + line for line in text.rstrip("\n").split("\n"))

    return _mapped(rows.select("entity_class", "entity_id", "body"), run, "entity_class string, entity_id string, text string")


def json_members(rows: DataFrame) -> DataFrame:
    """entity_class, entity_id, text: a body in JSON as a member of its class."""
    return rows.select("entity_class", "entity_id", F.concat(_quoted("entity_id"), F.lit(": "), F.col("body")).alias("text"))


def _quoted(name: str):
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(name)), r"^\[|\]$", "")


def write(members: DataFrame, path: str, form: str, head: str = "") -> None:
    """One document of members (entity_class, entity_id, text). Tasks write its parts in the shared folder, in the order of
    class and id; the parts are joined byte by byte, so no row comes to the driver."""
    spark = members.sparkSession
    rows = cut(members)
    ends = rows.groupBy("entity_class").agg(F.min("entity_id").alias("first_id"), F.max("entity_id").alias("last_id"))
    edges = ends.agg(F.min("entity_class").alias("first_class"), F.max("entity_class").alias("last_class"))
    rows = rows.join(F.broadcast(ends), "entity_class").join(F.broadcast(edges))
    first = F.col("entity_id") == F.col("first_id")
    if form == "yaml":
        line = F.concat(F.when(first, F.concat(_quoted("entity_class"), F.lit(":\n"))).otherwise(""), "text")
    else:
        opening = F.concat(F.when(F.col("entity_class") == F.col("first_class"), "{\n").otherwise("},\n"), _quoted("entity_class"), F.lit(": {\n"))
        closing = F.when((F.col("entity_class") == F.col("last_class")) & (F.col("entity_id") == F.col("last_id")), "\n}\n}").otherwise("")
        line = F.concat(F.when(first, opening).otherwise(","), "text", closing)
    folder = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    rows.select("entity_class", "entity_id", line.alias("value")).orderBy("entity_class", "entity_id").select("value").write.text(folder)
    _joined(spark, folder, path, head, "{}\n" if form == "json" else "")


def _joined(spark: SparkSession, folder: str, path: str, head: str, none: str) -> None:
    """The parts of a folder as one file, by the file systems that Spark uses; the folder goes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    source, target = at(folder).getFileSystem(conf), at(path).getFileSystem(conf)
    parts = sorted((s.getPath() for s in source.listStatus(at(folder)) if s.getLen() and s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    target.setWriteChecksum(False)  # a document may be edited by hand
    out = target.create(at(path), True)
    try:
        if text := head + (none if not parts else ""):
            out.write(bytearray(text.encode()))
        for p in parts:
            part = source.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
        target.setWriteChecksum(True)
    source.delete(at(folder), True)
