import random
import re

import pytest

from edgeloom.llm import licenses, queries
from edgeloom.llm.license_templates import TEMPLATES

from .corpus import ALNUM, LOWER, SCHEMA, documents

SMALL = (
    ("one", "use of [[all [[the]] parts]] is free for <<3>> only"),
    ("two", "<<licensed|free>> under <<a b|a|>> c [[d]]"),
    ("three", "x [[y]] [[y]] <<2>> [[z]]"),
)


def pattern(template):
    """The template as a regular expression over words with a space behind each."""
    out, done = "", 0
    plain = lambda s: "".join(re.escape(w) + " " for w in ALNUM.findall(s.translate(LOWER)))
    for m in licenses.MARKUP.finditer(template):
        out += plain(template[done : m.start()])
        done = m.end()
        if m[0] in ("[[", "]]"):
            out += "(?:" if m[0] == "[[" else ")?"
        else:
            out += rf"(?:[^ ]+ ){{0,{m[1]}}}" if m[1].isdigit() else "(?:" + "|".join(map(plain, m[1].split("|"))) + ")"
    return re.compile(out + plain(template[done:]))


def brute(text, templates):
    words = ALNUM.findall((text or "").translate(LOWER))
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    base = [(g, i, i + len(p.split())) for i in range(len(words)) for g, p in phrases.items() if words[i : i + len(p.split())] == p.split()]
    matches = []
    for label, t in templates:
        at, p = 0, pattern(t)
        while at < len(words):
            end = next((e for e in range(len(words), at, -1) if p.fullmatch(" ".join(words[at:e]) + " ")), None)
            if end:
                matches.append((label, at, end))
            at = end or at + 1
    hit = {k for _, a, b in base + matches for k in range(a, b)}
    return len(words), base, sorted(matches), len(hit) / len(words) if words else 0.0


def test_small_templates_against_regular_expressions(spark):
    rng = random.Random(1)
    vocabulary = "use of all the parts is free for only licensed under a b c d x y z mit License general public".split()
    starts = ["use of", "use of all parts is free for", "free under", "licensed under a", "x y", "MIT License", "general public license", "use of is free for a b c only"]
    texts = [" ".join(rng.choice(starts) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate([*texts, None, "", " .. ", texts[0]])]
    found = licenses.found(spark.createDataFrame(rows, SCHEMA).repartition(3), SMALL).collect()
    spans = lambda x: [tuple(s) for s in x]
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_words"], spans(r["base"]), sorted(spans(r["matches"])), r["score"]) == brute(rows[r["doc_id"]][1], SMALL), rows[r["doc_id"]][1]
    assert {m["label"] for r in found for m in r["matches"]} == {"one", "two", "three"}


def filled(template, drop):
    """A text that the template accepts: optional regions there or not, replaceable ones filled."""
    text = re.sub(r"<<(\d+)>>", "J. Doe and others" if not drop else "", template)
    text = re.sub(r"<<([^>]*)>>", lambda m: m[1].split("|")[0] or m[1].split("|")[-1], text)
    for _ in range(2 * drop):
        text = re.sub(r"\[\[[^\[\]]*\]\]", "", text)
    return text.replace("[[", " ").replace("]]", " ")


@pytest.mark.parametrize("drop", [True, False])
def test_every_licence_is_accepted_and_none_with_a_word_changed(drop):
    for label, t in TEMPLATES:
        text = filled(t, drop)
        _, _, matches = licenses.scan("Copyright (c) 2020.\n" + text + "\nrest")
        assert label in {m[0] for m in matches}, label
        assert len({m[0] for m in matches if m[2] - m[1] > 30}) <= 1
        words = licenses.words_of(filled(t, True))
        for k in range(1, len(words), 5):
            other = licenses.scan(" ".join([*words[:k], "zzz", *words[k + 1 :]]), ((label, t),))[2]
            assert all(m[2] - m[1] < len(words) - 1 for m in other) or words[k] in ("a", "the", "version"), (label, words[k])


def test_repeated_beginnings_take_linear_time():
    text = "licensed under the " * 50_000 + "permission is hereby granted " * 50_000 + "Licensed under CC BY-NC 4.0."
    n, base, matches = licenses.scan(text)
    assert (n, base, matches) == (350_007, [], [("cc-by-nc-4.0", 350_000, 350_007)])


def test_templates_must_begin_with_a_word_and_close_regions():
    for bad in ("<<3>> b", "a [[b", "a ]] b", "<<x|>>", "[[a]]", ""):
        with pytest.raises(ValueError):
            licenses.Automaton("bad", bad)


def test_query_rows(spark, tmp_path):
    rows = [*documents(), (500, "Under the MIT License.\nReleased under the MIT license, or the Apache License", "en", "s", 1, "k", "h", "g"), (501, "Licensed under CC BY-NC 4.0.", None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_license_templates(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert tuple(by[500])[1:8] == (13, 3, 2, 11, "apache,mit", "apache,mit", 9 / 13)
    assert tuple(by[501])[1:8] == (7, 0, None, None, "", "cc-by-nc-4.0", 1.0)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_license_templates(spark, f"{tmp_path}/none").collect() == []
