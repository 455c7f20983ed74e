import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import queries, recompression, substrings, suffixes
from edgeloom.llm.words import grams, mix

from .corpus import SCHEMA, SPACED, documents, plain


def smaller(texts, window):
    """doc_id -> flags of the words in windows that a smaller doc_id holds."""
    split = {i: SPACED.findall(t) for i, t in sorted(texts.items())}
    first = {}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (w, gone)
    return out


def test_windows_of_smaller_documents_go(spark):
    rows = documents(3)
    found = {r["doc_id"]: r for r in substrings.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect() if r["doc_id"] is not None}
    for i, (w, gone) in smaller(plain(rows), 13).items():
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["text"]) == (len(w), sum(gone), " ".join(kept))
        flags = [any(s["begin"] <= k < s["end"] for s in found[i]["removed"]) for k in range(len(w))]
        assert flags == gone


def test_contract_columns_and_empty_table(spark, tmp_path):
    spark.createDataFrame(documents(4, 12), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.queries()["op10_recompression"](spark, str(tmp_path)).collect()
    empty = next(r for r in rows if r["n_words"] == 0)
    assert empty["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=6), st.integers(3, 13))
def test_equal_windows_have_equal_anchors(texts, window):
    flat = np.array([x for t in texts for x in t], np.uint64)
    first = np.cumsum([0, *map(len, texts)])
    words = mix(flat + np.uint64(1))
    at, names, hashes = recompression.anchored(words, first, np.full(len(words), 3), window)
    seen = {}
    for p, name, h in zip(at, names, hashes, strict=True):
        key = tuple(flat[p : p + window])
        assert seen.setdefault(key, (name, h)) == (name, h)
    assert len(at) == sum(max(0, len(t) - window + 1) for t in texts)


def repeated(texts, window):
    split = {i: SPACED.findall(t) for i, t in sorted(texts.items())}
    places = {}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            places.setdefault(tuple(w[k : k + window]), []).append((i, k))
    out = {i: (set(), set()) for i in split}
    for found in places.values():
        for n, (i, k) in enumerate(found):
            if len(found) > 1:
                out[i][0].update(range(k, k + window))
            if n:
                out[i][1].update(range(k, k + window))
    return out


def spans(s):
    return {k for x in s for k in range(x["begin"], x["end"])}


def check_suffixes(spark, rows):
    found = suffixes.repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    wanted = repeated(plain(rows), 50)
    for r in found:
        if r["doc_id"] is not None:
            assert (spans(r["repeated"]) | set(), spans(r["removed"])) == wanted[r["doc_id"]]
            assert (r["n_repeated"], r["n_removed"]) == tuple(map(len, wanted[r["doc_id"]]))


def test_sorted_suffixes_against_all_windows(spark, monkeypatch):
    rows = [r for r in documents(5, 80) if r[0] is not None]
    check_suffixes(spark, rows)
    monkeypatch.setattr(suffixes, "TASK_ROWS", 3)
    monkeypatch.setattr(suffixes, "CHUNK", 5)
    check_suffixes(spark, rows)


def test_no_documents(spark):
    assert suffixes.repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_grams_of_short_texts():
    assert len(grams(np.zeros(3, np.uint64), 5)) == 0
