import random
import re
from collections import Counter

from edgeloom.llm import collocations

from .corpus import LOWER, documents

SCHEMA = "doc_id long, text string, lang string, phrase string, words int, a long, block string, n long"


def brute(rows, most=3, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), b in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * b >= inside * f[lang, p[i : i + k]]:
                    covered.add((lang, p[i : i + k]))
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in covered:
            s, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for k, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


def corpus(n=120):
    rng = random.Random(4)
    names = ["New York City", "new york", "Prime Minister", "a\tb", "São Paulo", "…ß ſtein", "ha ha ha ha", "ÀB Àb"]
    out = [(r[1], r[2]) for r in documents()]
    for _ in range(n):
        text = "".join(rng.choice(names) + rng.choice([" ", ", ", "  ", "\n", " the ", " of "]) for _ in range(rng.randint(0, 14)))
        out.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return [*out, ("x y " * 3000, "long"), ("x y z " * 5, "few"), (None, None), ("", None)]


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, g, "p", 1, 2, "b", 3) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in collocations.collocations(docs, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_plain_counts(spark):
    rows = corpus()
    found = run(spark, rows)
    assert found == brute(rows) and {r[0] for r in found} >= {"en", "und", "long"} and len(found) > 40


def test_longer_phrases_blocks_and_a_short_list(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 3)
    monkeypatch.setattr(collocations, "SALTS", 3)
    rows = corpus(60)
    more = {"most": 5, "least": 6, "inside": 70, "top": 12}
    assert run(spark, rows, **more) == brute(rows, **more)


def test_products_beyond_64_bits(spark):
    a, l, r = 3 * 10**13 + 7, 4 * 10**13 + 11, 5 * 10**13 + 13
    counts = spark.createDataFrame([("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, phrase string, words int, f long")
    assert [tuple(x) for x in collocations.scored(counts).collect()] == [("en", "x y", 2, a, l, r, 1_000_000 * a * a // (l * r))]


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), (" .. ", "en")]) == []
