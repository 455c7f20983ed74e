"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on the full shingle sets.

Definitions. A text is lower-cased (A-Z only) and cut into words `[^\\x20\\x09-\\x0D]+`; its set holds the distinct
runs of `width` words, or the whole sequence where it has fewer words. Two documents are linked when the Jaccard
similarity of their sets reaches `percent` / 100.

The forest has TREES orders. In each, the signatures of all different sets are sorted over the corpus, from another value
on. Sorted neighbours with a common prefix of DEPTH values or more are in one region, and each node's neighbours are
those with the longest common prefix, so deep where a region is crowded and no deeper than DEPTH where it is not. Each
node is first compared with its neighbour in its largest region, with that of longest prefix, and with the hub of its
regions. What those links leave open inside a region is compared in full (see linking.py), so that each pair that
shares a region is decided.

Edge cases: a null, empty or blank text has an empty set and is linked with nothing, so it is its own class; equal
texts meet as one node whatever their number; rows with the same doc_id are rows of their own, each with the class
of its text; a row with a null doc_id joins the class of an equal text only; an empty table gives an empty result.
Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import leader_pairs, linked_groups
from .store import id_text, scratch, size, small, small_batches, stored
from .words import SPACED_LOWER, blocks, grams, hashed_words, mix

WIDTH, PERCENT = 5, 85
#: Minhash values of a signature; sorted orders (trees); values by which an order sorts; values that a region shares.
VALUES, TREES, SORTED, DEPTH = 100, 20, 20, 5
#: Members of a region that are compared with each other where it is not settled; beyond, a prefix filter finds the pairs.
CROWD = 16
#: Pairs are confirmed when this many signature values agree: six standard errors below 0.85.
AGREE = 64
#: Rows of a sorted task, about.
TASK_ROWS = 100_000

_FACTORS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADDENDS = mix(_FACTORS)


def _sets(texts: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """For each block of rows, the sorted distinct shingle hashes of each row."""
    for _, _, data, offsets in blocks(texts):
        words, first, _, _ = hashed_words(data, offsets, SPACED_LOWER)
        runs = grams(words, width)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(runs[a : b - width + 1]))
            else:
                out.append(grams(words[a:b], int(b - a)) if b > a else words[:0])
        yield out


def _digest(s: np.ndarray) -> int:
    return int(mix(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of VALUES minhash values for each non-empty set."""
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), VALUES), np.uint32)
    for j in range(VALUES):
        out[:, j] = np.minimum.reduceat(flat * _FACTORS[j] + _ADDENDS[j], at) >> np.uint64(32)
    return out


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null for an empty one), sig (array of VALUES ints)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for sets in _sets(batch.column(1), width):
                sizes += [len(s) for s in sets]
                digests += [_digest(s) if len(s) else None for s in sets]
                full = [s for s in sets if len(s)]
                rows = iter(_signatures(full).view(np.int32) if full else ())
                sigs += [next(rows) if len(s) else None for s in sets]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "sig"])

    return id_text(docs).mapInArrow(sketch, "doc_id long, n_shingles long, digest long, sig array<int>")


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """digest and the full set (sorted shingle hashes) of each non-empty text."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in _sets(batch.column(1), width):
                full = [s for s in sets if len(s)]
                columns = [pa.array([_digest(s) for s in full], pa.int64()), pa.array([s.view(np.int64) for s in full], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "members"])

    return id_text(docs).mapInArrow(sets_of, "digest long, members array<long>")


def sort_keys(nodes: DataFrame) -> DataFrame:
    """(key, id): for each tree its number and the SORTED signature values, 16 bits each, by which it sorts a node."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sigs = batch.column(1).flatten().to_numpy().reshape(len(batch), VALUES)
            for tree in range(TREES):
                take = (np.arange(SORTED) + tree * (VALUES // TREES)) % VALUES
                rows = np.concatenate([np.full((len(batch), 1), tree), sigs[:, take] & 0xFFFF], axis=1).astype(">u2")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(0)], ["key", "id"])

    return nodes.select("id", "sig").mapInArrow(keys, "key binary, id long")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, id) in order: each two neighbours (a, b) in a region, its hash and the length of their common
    prefix; and the first and the last row, by their key."""
    names = ["region", "a", "b", "depth", "edge"]
    last = None
    for batch in batches:
        if not len(batch):
            continue
        ids, keys = batch.column(1).to_numpy(), batch.column(0)
        matrix = np.frombuffer(b"".join(keys.to_pylist()), ">u2").reshape(len(batch), SORTED + 1).astype(np.uint64)
        if last is None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([ids[0]]), pa.array([0], pa.int32()), keys.slice(0, 1)], names)
        else:
            ids, matrix = np.append(last[0], ids), np.concatenate([last[1], matrix])
        last = ids[-1], matrix[-1:], keys.slice(len(keys) - 1)
        differ = matrix[1:] != matrix[:-1]
        depth = np.where(differ.any(1), differ.argmax(1), SORTED + 1) - 1
        met = np.flatnonzero(depth >= DEPTH)
        region = np.zeros(len(met), np.uint64)
        for k in range(DEPTH + 1):
            region = mix(region * np.uint64(31) + matrix[met, k] + np.uint64(1))
        columns = [pa.array(region.view(np.int64)), pa.array(ids[met]), pa.array(ids[met + 1]), pa.array(depth[met], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(met), pa.binary())], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([last[0]]), pa.array([0], pa.int32()), last[2]], names)


def forest(nodes: DataFrame) -> DataFrame:
    """(region, a, b, depth): sorted neighbours in a region, with the length of their common prefix, in every tree.

    The order is dealt out in ranges of key and id, so that no region, however large, has to lie in one task. The first
    and last rows of the ranges, two for each task, are brought together to compare those on either side of a cut."""
    schema = "region long, a long, b long, depth int, edge binary"
    rows = sort_keys(nodes)
    tasks = max(1, min(-(-size(nodes) * TREES // TASK_ROWS), 1 << 15))
    found = rows.repartitionByRange(tasks, "key", "id").sortWithinPartitions("key", "id").mapInArrow(_neighbours, schema)
    found = stored(found, "forest")
    cuts = found.where("edge IS NOT NULL").select(F.col("edge").alias("key"), F.col("b").alias("id")).distinct()
    cuts = cuts.repartition(1).sortWithinPartitions("key", "id").mapInArrow(_neighbours, schema)
    return stored(found.union(cuts).where("edge IS NULL").drop("edge"), "neighbours")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (doc_id is component_id)."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(_verdicts(docs, width, percent), "verdicts")


def _verdicts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    base = stored(sketches(docs, width), "sketches")
    nodes = base.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))
    nodes = stored(nodes.withColumnRenamed("digest", "id"), "nodes")
    pairs = forest(nodes)
    members = pairs.select(F.col("region").alias("bucket"), F.col("a").alias("id")).union(pairs.select("region", "b")).distinct()
    members = stored(members, "members")
    sizes = stored(members.groupBy("bucket").agg(F.count("*").alias("size")), "sizes")
    live = members.join(small(sizes), "bucket")
    sized = pairs.withColumnRenamed("region", "bucket").join(small(sizes), "bucket")
    first = F.max(F.struct("size", "depth", "a"))["a"].alias("x"), F.max(F.struct("depth", "size", "a"))["a"].alias("y")
    chosen = sized.groupBy("b").agg(*first).select(F.explode(F.array("x", "y")).alias("a"), "b").union(leader_pairs(live))

    def some(ids: DataFrame) -> DataFrame:
        """The nodes of `ids` (id), which may repeat."""
        return nodes.join(small(stored(ids.distinct(), "ids")), "id", "left_semi")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = stored(some(ids).select(F.col("id").alias("digest"), F.col("doc").alias("doc_id")), "wanted")
        texts = id_text(docs).join(small(wanted.select("doc_id")), "doc_id", "left_semi")
        found = full_sets(texts, width).join(small(wanted.select("digest")), "digest", "left_semi")
        return found.groupBy(F.col("digest").alias("id")).agg(F.first("members").alias("members"))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))

    def near(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        sigs = stored(some(both(pairs)).select("id", "sig"), "sigs")
        rows = small(pairs).join(sigs.toDF("b", "y"), "b").join(sigs.toDF("a", "x"), "a")
        same = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda same: same))
        return rows.where(same >= AGREE).select("a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        sets = stored(sets_of(both(pairs)), "sets")
        rows = small(pairs).join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
        rows = rows.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("n"))
        return rows.where(f"100 * both >= {percent} * (n - both)").select("a", "b")

    def tokens(ids: DataFrame) -> DataFrame:
        return sets_of(ids).select("id", F.explode("members").alias("v"))

    classes = linked_groups(live, chosen, near, verify, tokens, percent, CROWD)
    placed = nodes.join(small(classes), "id", "left").select("id", "doc", F.coalesce("component", "id").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    labels = placed.join(smallest, "component").select(F.col("id").alias("digest"), "component_id")
    out = base.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all columns, that stand for their class. The rows of a doc_id stay if any of them does."""
    found = near_duplicates(docs, width, percent).select("doc_id", "kept")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    gone = small(stored(gone, "gone")).alias("gone")
    return docs.alias("docs").join(gone, F.col("docs.doc_id").cast("long") == F.col("gone.doc_id"), "left_anti")
