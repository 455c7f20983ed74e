"""Documents in splits: small splits cut through entities, strings and classes, and give what a plain parser gives."""

import json
import random

import pytest
import yaml
from pyspark.sql import functions as F

from edgeloom.operators import navigation
from edgeloom.plans.schema import Schema, empty_model
from edgeloom.sources import documents, hierarchical, readers, writers
from edgeloom.sources.star import ENERGY_SCHEMA

SCHEMA = Schema.composed([ENERGY_SCHEMA])


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, several to a task and each in its own."""

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield size
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def awkward(rng, n):
    """A document with brackets, quotes, backslashes and line ends in its texts, long bodies, empty classes and bodies."""
    odd = ["}", "{", '"', "\\", "]", "[", "\n", "\n\n", "# x", "- y", "é", " ", ": ", "a", ",", "\\\"}"]
    text = lambda k: "".join(rng.choice(odd) for _ in range(k))
    body = lambda: {"attributes": {"name": {"value": text(rng.choice([0, 3, 40, 400])), "unit": None}}, "relations": {"r": {"target_entity_ids": [text(3), "b"]}}} if rng.random() < 0.8 else {}
    return {c: {f"{c}.{k}{text(2).strip()}": body() for k in range(rng.choice([0, 1, n]))} for c in ("A", "B b", 'C"q', "D", "E", "F", "G")}


def flat(doc):
    return sorted((c, str(k), json.dumps(b or {}, sort_keys=True)) for c, members in doc.items() for k, b in (members or {}).items())


def found(df):
    return sorted((r["entity_class"], r["entity_id"], json.dumps(json.loads(r["body"]), sort_keys=True)) for r in df.collect())


@pytest.mark.parametrize("form", ["json", "compact", "yaml", "wide"])
def test_splits_give_what_a_parser_gives(spark, small_splits, tmp_path, form):
    rng = random.Random(form)
    doc = awkward(rng, 6)
    text = {"json": lambda: json.dumps(doc, indent=1), "compact": lambda: json.dumps(doc, separators=(",", ":"), ensure_ascii=False), "yaml": lambda: yaml.safe_dump(doc, sort_keys=False, allow_unicode=True), "wide": lambda: yaml.safe_dump(doc, sort_keys=False, indent=7, width=30, default_style="|")}[form]()
    path = tmp_path / ("d.json" if form in ("json", "compact") else "d.yaml")
    path.write_text(text)
    doc = yaml.safe_load(text) if path.suffix == ".yaml" else json.loads(text)  # literal style loses some blanks
    for n in (150, 1500):
        small_splits(n)
        rows = documents.entities(spark, str(path))
        assert found(rows) == flat(doc)
        order = [r["entity_id"] for r in rows.orderBy("seq").collect()]
        assert order == [k for members in doc.values() for k in members]


def test_lists_flow_forms_and_scalars(spark, small_splits, tmp_path):
    small_splits(60)
    doc = {"_meta": {"schema_version": "2.1.0"}, "A": [{"id": "a", "attributes": {"x": {"value": 1}}}, {"id": "b"}], "version": "1.0", "B": {"c": None, "d": {"attributes": {"y": [{}, []]}}}, "C": []}
    wanted = [("A", "a", '{"attributes": {"x": {"value": 1}}}'), ("A", "b", "{}"), ("B", "c", "{}"), ("B", "d", '{"attributes": {"y": [{}, []]}}')]
    forms = {"a.json": json.dumps(doc), "b.json": json.dumps(doc, indent=4), "c.yaml": yaml.safe_dump(doc, sort_keys=False), "d.yaml": json.dumps(doc, indent=2), "e.yaml": "# head\n---\n" + yaml.safe_dump(doc, default_flow_style=None, width=20), "f.yaml": "\ufeff" + yaml.safe_dump(doc)}
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        rows = documents.entities(spark, f"{tmp_path}/{name}")
        got = [(c, i, b if i != "c" else "{}") for c, i, b in found(rows.where("NOT startswith(entity_class, '_')"))]
        assert got == wanted, name
        assert [json.loads(r["body"]) for r in rows.where("entity_class = '_meta'").collect()] == [{"value": "2.1.0"}], name


def test_empty_documents_and_others(spark, tmp_path):
    for name, text in (("a.json", "{}"), ("b.json", ""), ("c.yaml", ""), ("d.yaml", "# nothing\n"), ("e.yaml", "A:\nB:\n")):
        (tmp_path / name).write_text(text)
        assert documents.entities(spark, f"{tmp_path}/{name}").count() == 0
    (tmp_path / "f.yaml").write_text("A:\n  a: {attributes: {x: *there}}\n")
    with pytest.raises(Exception, match="alias"):
        documents.entities(spark, f"{tmp_path}/f.yaml").collect()


def test_a_large_document_there_and_back_in_many_tasks(spark, small_splits, tmp_path):
    """200,000 entities in JSON and a tenth of them in YAML: read in many tasks, equal to the rows that were written."""
    n = 200_000
    base = spark.range(n).select(F.when(F.col("id") % 3 == 0, "ElectricalBus").otherwise("GenerationUnit").alias("entity_class"), F.concat(F.lit("e}\"."), F.col("id").cast("string")).alias("entity_id"), "id")
    empty = empty_model(spark, SCHEMA)
    m = readers.read_rows(
        empty,
        base.select("entity_class", "entity_id", F.col("id").alias("seq")),
        base.select("entity_class", "entity_id", F.lit("name").alias("attribute_id"), F.concat(F.lit("n\n{"), F.col("id").cast("string")).alias("value_str"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("provenance_ref")),
        base.where("id % 3 = 1").select("entity_class", "entity_id", F.lit("atNode").alias("relation_id"), F.concat(F.lit("e}\"."), (F.col("id") - 1).cast("string")).alias("target_id"), F.lit(0).alias("ord")),
    )
    sums = lambda t, *cs: t.agg(F.count("*"), F.sum(F.xxhash64(*cs).cast("decimal(38,0)"))).first()
    first = lambda t: t.where(F.substring_index("entity_id", ".", -1).cast("int") < n // 10)
    part = m.but(entity=first(m.entity), attr=first(m.attr), rel=first(m.rel))
    wanted = lambda m: (sums(m.attr, "entity_class", "entity_id", "attribute_id", "value_str"), sums(m.rel, "entity_class", "entity_id", "relation_id", "target_id", "ord"))
    for m, write, read, name in ((m, writers.write_json, readers.read_json, "m.json"), (part, writers.write_yaml, readers.read_yaml, "m.yaml"), (part, hierarchical.write_hierarchical_yaml, hierarchical.read_hierarchical_yaml, "h.yaml")):
        path = f"{tmp_path}/{name}"
        write(m, path)
        small_splits(1 << 20 if name == "m.json" else 1 << 17)
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        back = read(empty, path)
        assert wanted(back) == wanted(m)
    assert sum(map(len, json.load(open(f"{tmp_path}/m.json")).values())) == n


def test_unknowns_of_a_long_file_have_their_lines(spark, small_splits, tmp_path):
    small_splits(300)
    head = "entity_class,entity_id,attribute_id,attribute_value,attribute_unit,attribute_provenance,relation_type,relation_id"
    line = lambda k: f"GenerationUnit,g{k},{'odd' if k % 9 == 0 else 'name'},\"a, \"\"b\"\"\",,,,"
    lines = [head, *map(line, range(1, 60)), "", "Nowhere,x,name,1,,,,", "GenerationUnit,g1,,,,,atNode,b", "GenerationUnit,g1,,,,,besides,b"]
    (tmp_path / "l.csv").write_text("\n".join(lines) + "\n")
    m = empty_model(spark, SCHEMA)
    assert [tuple(r) for r in readers.numbered_lines(spark, f"{tmp_path}/l.csv").orderBy("line").collect()] == list(enumerate(lines, 1))
    wanted = [(k + 1, "GenerationUnit", f"g{k}", "attribute", "odd") for k in range(9, 60, 9)] + [(62, "Nowhere", "x", "class", "Nowhere"), (64, "GenerationUnit", "g1", "relation", "besides")]
    assert [tuple(r) for r in readers.long_csv_unknowns(m, f"{tmp_path}/l.csv").orderBy("line").collect()] == wanted
    assert readers.read_long_csv(m, f"{tmp_path}/l.csv").attr.where("attribute_id = 'name'").first()["value_str"] == 'a, "b"'


def test_trees_of_parts(spark):
    parts = spark.createDataFrame([("r", None, "r"), ("b", "r", "b"), ("a", "r", "a"), ("c", "a", "c"), ("lost", "gone", "lost"), ("x", "y", "x"), ("y", "x", "y")], "node string, parent string, key string")
    assert [tuple(r) for r in navigation.tree(parts).orderBy("path").collect()] == [("lost", 0, "lost"), ("r", 0, "r"), ("a", 1, "r/a"), ("c", 2, "r/a/c"), ("b", 1, "r/b")]
    assert navigation.tree(parts.limit(0)).count() == 0
