import math
import random

import numpy as np
import pytest

from edgeloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, q string, code string, salt int"


def brute(rows, parts, entries, rounds):
    """[(vec_id, code, error)] and the codebooks, in plain Python integers."""
    kept = [(r[0], [math.floor(1024 * x) for x in np.array(r[1], np.float32).tolist()]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    width = len(kept[0][1]) // parts
    cut = [[q[k * width : (k + 1) * width] for k in range(parts)] for _, q in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda c: [min((far(x, y), e) for e, y in enumerate(books[k])) for k, x in enumerate(c)]
    for _ in range(rounds):
        codes = [best(c) for c in cut]
        for k in range(parts):
            for e in range(len(books[k])):
                own = [c[k] for c, at in zip(cut, codes) if at[k][1] == e]
                if own:
                    books[k][e] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, tuple(e for _, e in best(c)), sum(d for d, _ in best(c))) for (i, _), c in zip(kept, cut)], books


def vectors(seed=3, n=90, width=8):
    rng = random.Random(seed)
    middles = [[rng.uniform(-0.4, 0.4) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in rng.sample(range(1000), n):
        m = rng.choice(middles)
        rows.append((i, [x + rng.uniform(-0.2, 0.2) for x in m], rng.choice([1, 1, 1, 2, None]), "q", "c", 0))
    zero, big = [0.0] * width, [3.0e4] * width
    rows += [(2000, None, 1, None, None, None), (2001, [None] + zero[1:], 1, None, None, None), (2002, [math.nan] + zero[1:], 2, None, None, None), (2003, [-math.inf] + zero[1:], 2, None, None, None)]
    rows += [(None, zero, None, None, None, None), (2004, big, 7, None, None, None), (2005, [-x for x in big], None, None, None, None)]
    return rows + [rows[0], rows[0]] + [(3000 + i, rows[1][1], 1, None, None, None) for i in range(20)]


@pytest.mark.parametrize(("entries", "rounds"), [(6, 4), (4, 1), (256, 2), (5, 0)])
def test_codes_errors_and_codebooks_against_plain_rounds(spark, entries, rounds):
    rows = vectors()
    found, books = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries, rounds=rounds)
    wanted, plain = brute(rows, 4, entries, rounds)
    found = vector_codes.by_label(found).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["vec_id"], tuple(r["code"]), r["error"]) for r in found), key=key) == sorted(wanted, key=key)
    assert books.tolist() == plain
    for label in {r["label"] for r in found}:
        own = [r for r in found if r["label"] == label]
        assert {r["label_error"] for r in own} == {sum(r["error"] for r in own)}


def test_many_labels_are_joined_in_parts(spark, monkeypatch):
    codes = spark.createDataFrame([(i, i % 3 or None, [i % 5], i) for i in range(50)], "vec_id long, label int, code array<short>, error long")
    want = sorted(vector_codes.by_label(codes).collect())
    monkeypatch.setattr(vector_codes, "small", lambda t: t)
    assert sorted(vector_codes.by_label(codes).collect()) == want and len(want) == 50


def test_only_changed_parts_contribute(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4], [0, 1], [0, 0]), ([5, 6, 7, 8], [1, 1], [1, 1]), ([9, 9, 9, 9], None, [1, 0])], "q array<long>, old array<short>, code array<short>")
    found = {tuple(r)[:3]: r["value"] for r in vector_codes.contributions(rows.coalesce(1), (2, 2, 2)).collect()}
    assert found == {(0, 1, -1): 1, (0, 1, 0): 9, (0, 1, 1): 9, (1, 0, -1): 2, (1, 0, 0): 12, (1, 0, 1): 13, (1, 1, -1): -1, (1, 1, 0): -3, (1, 1, 1): -4}


def test_empty_and_unequal(spark):
    for rows in ([], [(1, None, 1, None, None, None)]):
        found, books = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA))
        assert books is None and vector_codes.by_label(found).collect() == []
    assert vector_codes.digest(None) == vector_codes.hashlib.sha256(b"").hexdigest()
    for bad in ([(1, [1.0] * 8), (2, [1.0] * 4)], [(1, [1.0] * 6)], [(1, [3e38] * 4)]):
        with pytest.raises(ValueError):
            vector_codes.compressed(spark.createDataFrame([(*r, 1, None, None, None) for r in bad], SCHEMA))
