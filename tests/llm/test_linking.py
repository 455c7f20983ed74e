import random

from edgeloom.llm.linking import components

from .corpus import Sets


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    wanted = {x: sets.root(x) for e in edges if e[0] != e[1] for x in e}
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == wanted


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_candidates_of_a_family_grow_with_its_size(spark, monkeypatch):
    """Near copies of one text, each with 10 of 300 words changed in one place: their classes are those of brute force, and
    twice as many make about twice as many candidates, far fewer than all pairs."""
    from edgeloom.llm import near_dedup, store

    tried = {}
    made = store.stored
    for n in (150, 300):
        rng = random.Random(9)
        base = [f"w{k}" for k in range(300)]
        texts = []
        for _ in range(n):
            w, at = list(base), rng.randrange(290)
            w[at : at + 10] = [f"x{rng.randrange(10**6)}" for _ in range(10)]
            texts.append(" ".join(w))
        seen = []

        def counted(df, name):
            out = made(df, name)
            if name in ("met", "candidates"):
                seen.append((name, store.size(out)))
            return out

        monkeypatch.setattr(store, "stored", counted)
        found = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        monkeypatch.setattr(store, "stored", made)
        sets, classes = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts], Sets()
        for a in range(n):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    classes.join(a, b)
        assert {r["doc_id"]: r["component_id"] for r in found} == {k: classes.root(k) for k in range(n)}
        tried[n] = sum(k for _, k in seen)
        assert {name for name, _ in seen} == {"met", "candidates"}, seen
    print(tried)
    assert tried[300] <= 3 * tried[150] + 300 and tried[300] < 300 * 299 / 8
