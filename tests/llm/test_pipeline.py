import random
import sys
from collections import defaultdict
from itertools import batched

from pyspark.sql import functions as F

import corpus_pipeline

from .test_texts import hits

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_on_what_is_left(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, DATA)
        after.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage{k}")
        after = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage{k}")
        if name != "packing":
            assert after.columns == columns
            assert after.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
            before = after
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in before.collect()}
    assert not any(hit for _, hit, _ in hits(left, benchmark).values())
    lines = defaultdict(set)
    for i, t in left.items():
        for x in t.split("\n"):
            if x.strip():
                lines[x].add(i)
    assert all(len(v) == 1 for v in lines.values())
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == set(left)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and not rows.isEmpty()


ODD = {"key": "k", "gone": "g", "hit": "h", "component_id": "c", "line": "l"}


def through(spark, docs, name):
    """Column names and rows after each stage."""
    out = []
    for k, (stage, apply) in enumerate(corpus_pipeline.STAGES):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name}{k}"
        apply(spark, docs, DATA).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out.append((stage, docs.columns, docs.collect()))
    return out


def test_nulls_empty_and_repeated_rows(spark):
    """Texts that are null, empty, blank or without a letter go first. Of copies under several ids the first stays, a row
    that is there twice stays at least once, and nulls in other columns and columns with the names of inner ones do not
    matter."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sample = docs.where("lang IS NOT NULL AND size(split(text, ' ')) > 200").orderBy("doc_id").first()["text"].split()[:150]
    clean = lambda salt: "\n".join(" ".join(w) for w in batched(random.Random(salt).sample(sample, len(sample)), 12))
    rows = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "123 456 7890"), (9005, clean("alpha")), (9006, clean("alpha")), (9007, clean("beta")), (9007, clean("beta")), (9008, clean("gamma"))]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(more.select(*(more[f.name].cast(f.dataType).alias(f.name) for f in docs.schema)))
    for name, v in ODD.items():
        both = both.withColumn(name, F.when(F.col("doc_id") % 2 == 0, F.lit(v)))
    stages = through(spark, both, "odd")
    assert all(columns == both.columns for stage, columns, _ in stages if stage != "packing")
    ids = {stage: {r["doc_id"] for r in found} for stage, _, found in stages}
    assert not ids["language"] & {9001, 9002, 9003, 9004}
    assert ids["language"] >= {9005, 9006, 9007, 9008} and ids["packing"] & set(range(9001, 9009)) == {9005, 9007, 9008}
    assert all(r["key"] == ("k" if r["doc_id"] % 2 == 0 else None) for _, _, found in stages[:-1] for r in found)


def test_a_worker_drops_what_packing_kept_when_it_cuts_texts():
    """The encoder with all its runs stayed in each Python worker through the stages of the next run."""
    import pyarrow as pa

    from edgeloom.llm import packing, words

    kept = packing.encoder(packing.TOKENIZER)
    ids = kept(["two words"])
    assert packing.encoder(packing.TOKENIZER) is kept
    assert len(list(words.blocks(pa.array(["two words"])))) == 1 and "edgeloom_worker" not in sys.modules
    assert packing.encoder(packing.TOKENIZER) is not kept and packing.encoder(packing.TOKENIZER)(["two words"]) == ids


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 0")
    for stage, columns, found in through(spark, docs, "none"):
        assert found == [] and (stage == "packing" or columns == docs.columns)
