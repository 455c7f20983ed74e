import random

import numpy as np
import pyarrow as pa
import pytest

from edgeloom.llm import near_dedup

from .corpus import LOWER, SCHEMA, SPACED, Sets, documents, edited, plain, words


def brute(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = SPACED.findall(t.translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    classes = Sets()
    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                classes.join(a, b)
    return {i: (len(s), classes.root(i), classes.root(i) == i) for i, s in sets.items()}


def check(spark, rows, percent=85):
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=percent).collect()
    assert len(found) == len(rows)
    wanted = brute(plain(rows), percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None} == wanted


def test_against_brute_force(spark):
    check(spark, documents())


def test_a_hub_with_copies_that_link_only_to_it(spark, monkeypatch):
    """Copies of a text with two edits each are linked with it, not with each other: with small crowds, block by block."""
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    rng = random.Random(5)
    base = " ".join(words(rng, 150))
    texts = [edited(rng, base, 2) for _ in range(30)] + [base] + [edited(rng, base, 3) for _ in range(30)]
    check(spark, [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)])


def test_candidates_are_sorted_neighbours_with_their_common_prefix(spark, monkeypatch):
    """However the order is cut into ranges, the neighbours in each tree are those of one sort over all nodes."""
    rng = np.random.default_rng(2)
    sigs = np.repeat(rng.integers(0, 1 << 16, (6, near_dedup.VALUES)), 20, axis=0)
    sigs[rng.random(sigs.shape) < 0.15] = 7
    nodes = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sigs)], "id long, sig array<int>")
    wanted = set()
    for tree in range(near_dedup.TREES):
        key = lambda k, t=tree: tuple(sigs[k][(t * 5 + j) % near_dedup.VALUES] for j in range(near_dedup.SORTED))
        order = sorted(range(len(sigs)), key=lambda k: (key(k), k))
        for a, b in zip(order, order[1:]):
            depth = next((j for j, (x, y) in enumerate(zip(key(a), key(b))) if x != y), near_dedup.SORTED)
            if depth >= near_dedup.DEPTH:
                wanted.add((a, b, depth))
    for rows in (100_000, 150):
        monkeypatch.setattr(near_dedup, "TASK_ROWS", rows)
        found = near_dedup.forest(nodes).collect()
        assert wanted <= {(r["a"], r["b"], r["depth"]) for r in found}
        assert len(found) <= len(wanted) + 64
        regions = {}
        for r in found:
            regions.setdefault(r["region"], set()).update((r["a"], r["b"]))
        assert all(len({tuple(sigs[k][(t * 5 + j) % 100] for j in range(5)) for k in m}) == 1 for m in regions.values() for t in [next(t for t in range(20) if len({tuple(sigs[k][(t * 5 + j) % 100] for j in range(5)) for k in m}) == 1)])


def test_neighbours_of_no_rows():
    assert list(near_dedup._neighbours(iter([pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int64())], ["key", "id"])]))) == []


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(3, "a b c d e f", 1, 2, 3), (2, "A b c d e f", 1, 2, 3), (2, "A b c d e f", 1, 2, 3), (None, "a b c d e f", 1, 2, 3), (5, None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, kept int, `docs.doc_id` int")
    out = near_dedup.representatives(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 2, 2, 5]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_representatives_keep_one_of_each_class(spark):
    rows = documents(2)
    kept = near_dedup.representatives(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    wanted = {i for i, (_, _, k) in brute(plain(rows)).items() if k}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == wanted


@pytest.mark.parametrize("n", [1, 4, 5, 6])
def test_short_texts_are_one_shingle(spark, n):
    rows = [(k, " ".join("abcdefgh"[:n]), None, None, None, None, None, None) for k in (4, 2)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["n_shingles"], r["component_id"]) for r in found} == {(max(1, n - 4), 2)}
