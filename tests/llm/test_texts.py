"""Quality, language, decontamination, packing, personal data, revisits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from edgeloom.llm import decontaminate, language, packing, pii, quality, store, warc

from .corpus import ALNUM, LOWER, SCHEMA, SPACED, documents, plain

LABELS = "doc_id long, quality int, toxic int"


def test_base_counts_against_python(spark):
    rows = documents(7)
    labels = spark.createDataFrame([(0, 1, 0), (10, 1, 0), (20, 0, 0), (None, 1, 1), (6, None, None)], LABELS)
    found = quality.verdicts(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            continue
        text = plain(rows)[r["doc_id"]]
        w = SPACED.findall(text)
        counts = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for k in range(len(w) - 2) if counts[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_scores_against_python(spark):
    """The log-likelihood ratio from the counts of hashed uni- and bigrams of trusted and of all documents."""
    rows = [r for r in documents(7) if r[0] is not None]
    trusted = {k for k in range(0, 60, 3)}
    labels = spark.createDataFrame([(k, 1, 0) for k in trusted] + [(1, 0, 0)], LABELS)
    words = sorted({w for r in rows for w in SPACED.findall(r[1] or "")})
    pairs = sorted({p for r in rows for w in [SPACED.findall(r[1] or "")] for p in zip(w, w[1:], strict=False)})
    hashes = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) AS h").collect()
    of_word = {r["w"]: r["h"] for r in hashes}
    of_pair = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "xxhash64(xxhash64(a), xxhash64(b)) AS h").collect()}
    grams = lambda t: [h % quality.BUCKETS for w in [SPACED.findall(t or "")] for h in [*(of_word[x] for x in w), *(of_pair[p] for p in zip(w, w[1:], strict=False))]]
    raw, good = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1]))
        good.update(grams(r[1]) if r[0] in trusted else [])
    n, m, prior = sum(raw.values()), sum(good.values()), quality.PRIOR * quality.BUCKETS
    weight = {b: np.log((good[b] + quality.PRIOR) / (m + prior)) - np.log((raw[b] + quality.PRIOR) / (n + prior)) for b in raw}
    texts = plain(rows)
    for r in quality.verdicts(spark.createDataFrame(rows, SCHEMA), labels).collect():
        own = [weight[b] for b in grams(texts[r["doc_id"]])]
        assert abs(r["score"] - (sum(own) / len(own) if own else 0.0)) < 1e-9


def test_good_documents_keep_clashing_columns(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(60)) if k else "short", 1, 2, 3) for k in (0, 1, 1, 2)]
    docs = spark.createDataFrame([*rows, (None, None, 1, 2, 3)], "doc_id long, text string, good int, kept int, `good.doc_id` int")
    out = quality.keep_good(docs, spark.createDataFrame([(1, 1, 0)], LABELS), threshold=-5.0)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 1, 2]


def test_mixtures_against_a_plain_search():
    """Expectation-maximisation and the penalised choice, against a search over a grid of all mixtures of each set."""
    rng = np.random.default_rng(3)
    frequencies = rng.dirichlet(np.full(40, 0.2), 3).T.astype(np.float32) + 1e-4
    frequencies /= frequencies.sum(0)
    full = np.full((1 << language.BITS, 3), 1e-9, np.float32)
    full[:40] = frequencies
    for wanted in ([1, 0, 0], [0.5, 0.5, 0], [0, 0.3, 0.7], [0.4, 0.3, 0.3]):
        grams = rng.choice(40, 3000, p=(frequencies @ np.array(wanted) / (frequencies @ np.array(wanted)).sum())).astype(np.uint16)
        counts = np.bincount(grams, minlength=40)
        fine = 0.5 * language.GRAM * np.log(len(grams))
        steps = np.arange(0, 1.0001, 0.02)
        grid = [(a, b, max(0.0, 1 - a - b)) for a in steps for b in steps if a + b <= 1.0001]
        best = max(grid, key=lambda w: counts @ np.log(frequencies @ np.array(w)) - fine * (sum(x > 1e-6 for x in w) - 1))
        found = language.proportions(grams, full)
        assert [x > 0 for x in found] == [x > 1e-6 for x in best]
        assert np.abs(found - best).max() < 0.03


def test_texts_in_no_learned_language_go_and_all_stay_without_labels(spark):
    import random

    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [(10**6 + k, " ".join("".join(rng.choice("qxzjkvwy") for _ in range(9)) for _ in range(80)), None) for k in range(5)]
    more = docs.union(spark.createDataFrame(noise, docs.schema))
    kept = {r["doc_id"] for r in language.keep_identified(more).select("doc_id").collect()}
    assert not any(k >= 10**6 for k in kept) and len(kept) >= 0.97 * docs.count()
    bare = more.limit(20).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang").union(spark.createDataFrame([(1, "12", None)], docs.schema))
    assert language.keep_identified(bare).count() == bare.where("text RLIKE '[A-Za-z]'").count()


def test_without_trusted_documents_scores_are_zero(spark):
    rows = quality.verdicts(spark.createDataFrame(documents(7, 10), SCHEMA), spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in rows} == {0.0}
    assert quality.verdicts(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out()).collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)
    assert all(abs(sum(x["share"] for x in r["languages"]) - 1) < 1e-6 for r in rows if r["languages"])


def test_language_edge_cases_and_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["lang"]: r["text"] for r in docs.where("doc_id % 7 = 3 and length(text) between 2000 and 4000").collect()}
    odd = [(1, None), (2, ""), (3, "12 34 !!"), (4, texts["de"][:2000] + " " + texts["es"][:1500])]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    model = language.learn(docs)
    found = {r["doc_id"]: r for r in language.predict(frame, model).collect()}
    assert [found[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and found[1]["score"] == 0.0
    assert {x["lang"] for x in found[4]["languages"]} == {"de", "es"} and found[4]["lang_pred"] == "de"
    assert {r["lang_pred"] for r in language.predict(frame, language.learn(docs.limit(0))).collect()} == {"und"}
    kept = language.keep_identified(docs.limit(50).union(docs.limit(1).selectExpr("99999L", "'123'", "lang", "source", "n_chars")))
    assert kept.columns == docs.columns and kept.where("doc_id = 99999").isEmpty()


def hits(texts, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for i, t in texts.items():
        w, at, found = ALNUM.findall(t.translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    at.update(range(k, k + n))
        out[i] = (len(w), len(at), ",".join(sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_contamination_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(store, "BROADCAST_ROWS", broadcast)
    rows = documents(8)
    texts = plain(rows)
    items = [(1, " ".join(texts[3].split()[-40:-10])), (12, texts[13][:150].upper()), (2, "One"), (3, "a B, c d"), (4, None), (5, "!!"), (None, " ".join(texts[0].split()[:12])), (12, "x y z")]
    found = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(rows)
    wanted = hits(texts, items)
    for r in found:
        if r["doc_id"] is not None:
            n, hit, names = wanted[r["doc_id"]]
            assert (r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) == (n, hit, hashlib.sha256(names.encode()).hexdigest(), hit > 0)
    assert sum(r["contaminated"] for r in found) > 3


def test_clean_documents_stay(spark):
    rows = documents(8, 20)
    benchmark = spark.createDataFrame([(1, " ".join(plain(rows)[3].split()[-30:]))], "item_id long, text string")
    kept = decontaminate.clean_documents(spark.createDataFrame(rows, SCHEMA), benchmark)
    wanted = {i for i, (_, hit, _) in hits(plain(rows), [(1, " ".join(plain(rows)[3].split()[-30:]))]).items() if not hit}
    assert {r["doc_id"] for r in kept.collect()} - {None} == wanted


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*documents(9, 40), (900, "don't İstanbul ΣΑΣ <|endoftext|> a\x1cb ½ 日本", None, None, None, None, None, None), (901, "word " * 9000, None, None, None, None, None, None)]
    encode = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)).encode
    found = packing.packed(spark.createDataFrame(rows, SCHEMA), ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    for i, text in plain(rows).items():
        ids = [*encode(text, add_special_tokens=False).ids, 2]
        copies = 3 if i == 0 else 1
        assert sum(r["length"] for r in pieces[i]) == copies * len(ids)
        for r in pieces[i]:
            own = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert (bytes(r["ids"]), r["ids_crc32"], r["doc_tokens"]) == (own, zlib.crc32(own), len(ids))
    assert packing.packed(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 64, 65, 700, 2047, 2048, 3000, 4095, 4096, 4097, 123_456])
def test_cuts_cover_and_fill(n):
    at = 0
    for start, length, j in packing.cuts(n):
        assert start == at and j * length <= 4096
        assert 4096 - j * length <= max(packing.SLACK, length)
        at += length
    assert at == n


def spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


TEXTS = ["mail a.b@x.example.com, 10.0.0.1 and 300.1.1.1.5", "é 4111 1111-1111 1111 +1 (555) 010-9999 +12", "v1.2.3.4.5.6 4111111111111112", "@@ a@b a@b.c@d.e", "", None, "0000.1.2.3 99999999999999999999"]


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_base_patterns(text):
    assert pii.base_spans(text) == spans(text)


def test_contexts_discover_unseen_identifiers(spark):
    known = [(k, f"please dial +1 (555) 010-{1000 + k} today, row {k}") for k in range(12)]
    new = [(100, "please dial 555 010 77 99 today, row 5"), (101, "the year 2020-2021 was 555 010 77 99 long"), *((200 + k, t) for k, t in enumerate(TEXTS)), (None, None)]
    rows = pii.find(spark.createDataFrame(known + new, "doc_id long, text string")).collect()
    assert len(rows) == len(known) + len(new)
    found = {r["doc_id"]: r for r in rows}
    assert [(s["kind"], s["start"], s["end"]) for s in found[100]["spans"]] == [("phone", 12, 25)] and found[100]["base"] == []
    assert found[101]["spans"] == []
    for k, t in enumerate(TEXTS):
        assert [tuple(s) for s in found[200 + k]["base"]] == spans(t or "")
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_secrets_are_found_by_their_context(spark):
    import random

    rng = random.Random(1)
    digits = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    known = [(k, f'words here token = "{digits(40)}" and more {k}') for k in range(9)]
    commits = [(50 + k, f"see commit {digits(40)} of the tree") for k in range(9)]
    new = [(100, 'TOKEN = "Zx81_kQ7-44hTTb20Pq" rest'), (101, "the part Zx81_kQ7-44hTTb20Pq is listed")]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(spark.createDataFrame(known + commits + new, "doc_id long, text string")).collect()}
    assert all(found[k] == [("secret", 20, 60)] for k in range(9))
    assert all(found[50 + k] == [] for k in range(9)) and found[101] == []
    assert found[100] == [("secret", 9, 28)]


def test_checksums_are_no_secrets(spark):
    """Logs and lock files: what commit, sha256 = or integrity: names is never reported, whatever else is learned."""
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f"commit: {digits(40)}\nsha256 = {digits(64)}\n") for k in range(20)]
    rows += [(100 + k, f'integrity: {digits(64)}\netag = "{digits(32)}"\nmd5: {digits(32)} checksum = {digits(40)}') for k in range(20)]
    rows += [(200 + k, f'api_key = "{digits(40)}"') for k in range(20)] + [(300, f"id = {digits(40)}"), (301, f"build {digits(40)}")]
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, v in found.items() if v} == set(range(200, 220))


def test_contexts_with_many_unseen_values(spark):
    """30 phones with a plus sign and 30 without in one context: the latter are found. Numbers in a context without known
    phones, or in one that other things stand in as well, are not."""
    rng = random.Random(7)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows = [(k, f"please call phone +41{number(9)} today") for k in range(30)] + [(100 + k, f"please call phone 079{number(7)} today") for k in range(30)]
    rows += [(200 + k, f"order number {number(9)} was sent") for k in range(30)]
    rows += [(300 + k, f"about {'+41' if k % 2 else ''}{number(9)} there") for k in range(30)] + [(400 + k, f"about 10.0.{k}.7 there") for k in range(30)]
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(spans[100 + k] == ["phone"] for k in range(30)) and not any(spans[200 + k] for k in range(30))
    assert not any(spans[300 + k] for k in range(0, 30, 2)) and all(spans[k] == ["phone"] for k in range(30))


def test_confidence_of_contexts_against_python(spark):
    import random

    rng = random.Random(8)
    rows = [(f"v{v}", [f"c{2 * rng.randrange(5) + (v + (rng.random() < 0.08)) % 2}" for _ in range(rng.randint(0, 3))]) for v in (rng.randrange(40) for _ in range(400))]
    seeds = {f"v{k}": ("ip", "phone")[k % 2] for k in range(26)}
    likely = [(v, seeds.get(v), ["phone"] if int(v[1:]) % 3 else ["ip", "phone"], c) for v, c in rows]
    for confident in (0.7, 0.45):
        known, best = {(v, k) for v, k, _, _ in likely if k}, set()
        edges = {(c, v) for v, _, _, cs in likely for c in cs}
        for _ in range(3):
            best = set()
            for c in {c for c, _ in edges}:
                values = {v for d, v in edges if d == c}
                for kind in ("ip", "phone"):
                    n = sum((v, kind) in known for v in values)
                    if n >= 5 and n / (len(values) + 1) >= confident:
                        best.add((c, kind))
            known = {(v, k) for v, k, _, _ in likely if k} | {(v, k) for v, own, forms, cs in likely if not own for c in cs for d, k in best if c == d and k in forms}
        found = pii.confident_contexts(spark.createDataFrame(likely, "value string, kind string, forms array<string>, contexts array<string>"), confident=confident)
        assert {tuple(r) for r in found.collect()} == best
    assert best


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a1b2", "(", "1 ", "@a.", "+1"])
def test_patterns_are_linear_in_long_runs(unit):
    import time

    took = []
    for n in (50_000, 200_000):
        text = unit * (n // len(unit)) + "@"
        began = time.perf_counter()
        pii._scan(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "@a.b@c.d", "x@@y.z", "a@b@c.d", "1.2.3.4.5.6.7.8", "0" * 5000 + ".0.0.1", "256.1.1.1.1"])
def test_rewritten_patterns_match_as_before(text):
    by_pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    fits = lambda kind, s: kind == "email" or all(int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    wanted = [(k, *m.span()) for k, p in by_pattern.items() for m in re.finditer(p, text) if fits(k, m[0])]
    assert [s for s in pii.base_spans(text) if s[0] in by_pattern] == wanted


RECORD = "record_id long, url string, time long, status int, headers array<struct<name: string, value: string>>, payload string, found string"


def test_revisits_resolve_to_the_latest_earlier_response(spark):
    tag = lambda v: [("ETag", v)]
    rows = [
        (1, "http://www.A.example:80/x/?utm_source=f&b=2&a=1#top", 10, 200, [*tag('"one"'), ("Content-Length", "3"), ("X", "old")], "one", None),
        (2, "https://a.example/x?a=1&b=2", 20, 200, tag('"two"'), "two", None),
        (3, "https://a.example/x?b=2&a=1", 15, 304, [*tag('W/"one"'), ("content-length", "0"), ("x", "new")], None, None),
        (4, "https://a.example/x?b=2&a=1", 20, 304, tag('"two"'), None, None),
        (5, "https://a.example/x?b=2&a=1", 30, 304, tag('"one"'), None, None),
        (6, "https://a.example/x?b=2&a=1", 5, 304, tag('"one"'), None, None),
        (7, "https://a.example/x?b=2&a=1", 31, 304, None, None, None),
        (8, None, 31, 304, tag('"one"'), None, None),
        (9, "https://a.example/x?b=2&a=1", None, 304, tag('"one"'), None, None),
        (5, "https://a.example/x?b=2&a=1", 30, 304, tag('"one"'), None, None),
        (10, "https://b.example/", 1, 404, None, None, None),
    ]
    found = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows, RECORD), blocks=4).collect()}
    states = {i: (r["state"], r["source_id"], r["payload"]) for i, r in found.items()}
    assert states == {3: ("resolved", 1, "one"), 4: ("resolved", 2, "two"), 5: ("mismatch", 2, None), 6: ("missing", None, None), 7: ("unverifiable", 2, None), 8: ("missing", None, None), 9: ("missing", None, None)}
    assert found[3]["headers"] == {"etag": 'W/"one"', "content-length": "3", "x": "new"}
    assert warc.resolve(spark.createDataFrame([], RECORD)).collect() == []


def test_as_of_in_blocks_equals_a_plain_scan(spark):
    import random

    rng = random.Random(4)
    rows = [(k, f"http://h.example/{0 if rng.random() < 0.6 else rng.randrange(5)}", rng.randrange(300), 200 if rng.random() < 0.4 else 304, [("etag", "t")], str(k), None) for k in range(400)]
    found = {r["record_id"]: r["source_id"] for r in warc.resolve(spark.createDataFrame(rows, RECORD), blocks=16).collect()}
    for i, url, t, status, *_ in rows:
        if status == 304:
            earlier = [(x[2], x[0]) for x in rows if x[3] == 200 and x[1] == url and (x[2], x[0]) < (t, i)]
            assert found[i] == (max(earlier)[1] if earlier else None)


def test_revisits_without_an_id_and_with_timestamps(spark):
    import datetime as dt

    day = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(days=k)
    rows = [(None, f"http://h.example/{k}", day(5), 304, None, None) for k in range(3)]
    rows += [(1, "http://h.example/0", day(1), 200, [("etag", "a")], "body"), (2, "http://h.example/0", day(9), 304, [("etag", "a")], None)]
    rows += [(2, "http://h.example/0", day(10), 304, [("etag", "b")], None), (None, "http://h.example/0", day(8), 200, [("etag", "c")], "nobody")]
    records = spark.createDataFrame(rows, "record_id long, url string, time timestamp, status int, headers array<struct<name: string, value: string>>, payload string")
    for blocks in (None, 4):
        found = warc.resolve(records, blocks=blocks).collect()
        assert sorted((r["record_id"] or 0, r["url"][-1], r["state"], r["payload"]) for r in found) == [(0, "0", "missing", None), (0, "1", "missing", None), (0, "2", "missing", None), (2, "0", "resolved", "body")]


def test_clean_documents_keep_clashing_columns(spark):
    rows = [(1, "a b c", 1, 2, 3), (1, "a b c", 1, 2, 3), (2, None, 1, 2, 3), (None, "x y z", 1, 2, 3), (3, "q", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit int, key int, `hit.key` int")
    out = decontaminate.clean_documents(docs, spark.createDataFrame([(1, "x Y")], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 1, 2, 3]
    assert decontaminate.clean_documents(docs, spark.createDataFrame([], "item_id long, text string")).count() == 5


def test_other_vocabularies_encode_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    name = "byte_bpe_50k.json"
    text = "Don't split THIS 12 345 ways, Ωmega"
    wanted = [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids, 2]
    found = packing.packed(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer=name, ids=True).collect()
    assert np.frombuffer(b"".join(bytes(r["ids"]) for r in found), "<u4").tolist() == wanted
