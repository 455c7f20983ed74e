import random
import time

from edgeloom.llm import line_dedup

from .corpus import SCHEMA, SPACED, Sets, documents, edited, plain, words


def shingles(line, width=9):
    b = line.encode("utf-16-be")
    return {b[2 * i : 2 * (i + width)] for i in range(max(1, len(b) // 2 - width + 1))}


def brute(texts, percent=80):
    first = {}
    for i, t in sorted(texts.items()):
        for k, line in enumerate(t.split("\n")):
            if SPACED.search(line):
                first.setdefault(line, (i, k))
    lines, classes = list(first), Sets()
    sets = {x: shingles(x) for x in lines}
    for n, a in enumerate(lines):
        for b in lines[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                classes.join(first[a], first[b])
    return {i: [k for k, line in enumerate(t.split("\n")) if SPACED.search(line) and classes.root(first[line]) != (i, k)] for i, t in texts.items()}


def corpus():
    rng = random.Random(9)
    rows = [r for r in documents(6, 30) if r[0] is not None]
    near = [" ".join(words(rng, 40)) for _ in range(6)]
    return rows + [(1000 + k, edited(rng, near[k % 6], 1) + "\n" + " ".join(words(rng, 9)), "en", "s", 1, "k", "h", "sig") for k in range(30)]


def test_lines_against_brute_force(spark):
    rows = corpus()
    found = line_dedup.summary(spark.createDataFrame(rows, SCHEMA)).collect()
    wanted = brute(plain(rows))
    wrong = [r["doc_id"] for r in found if r["removed"] != wanted[r["doc_id"]]]
    assert len(wrong) <= 1  # banding finds a pair at the threshold with a probability of 0.995


def test_templated_lines_in_crowded_bands_against_brute_force(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    template, texts = letters(300), {}
    for k in range(120):
        own = letters(42)
        texts |= {2 * k: template + own + letters(3), 2 * k + 1: template + own + letters(3)}
    found = line_dedup.summary(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    wanted = brute(texts)
    assert sum(map(len, wanted.values())) == 120
    assert {r["doc_id"]: r["removed"] for r in found} == wanted


def test_short_lines_are_found(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(13)) for _ in range(500)]
    rows = [(k, x + "\n" + x[:12]) for k, x in enumerate(lines)]
    found = line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["removed"] == [1] for r in found) >= 0.97 * len(rows)  # 4 of 5 shingles in common: banding finds 0.987


def test_documents_lose_lines_and_keep_columns(spark):
    rows = [(1, "same line of text\nother words here", "en", "s", 1, "k", "h", "g"), (2, "same line of text\n\nnew", "en", "s", 1, "k", "h", "g"), (3, "same line of text", "en", "s", 1, "k", "h", "g"), (4, None, None, None, None, None, None, None)]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "same line of text\nother words here", 2: "\nnew", 4: None}


def test_empty_table(spark):
    assert line_dedup.summary(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bands_share_one_bin_at_most():
    groups = [set(x) for x in line_dedup.BANDS]
    assert len(groups) == 10 and line_dedup.BINS == 15
    assert all(len(g) == 3 for g in groups)
    assert all(len(a & b) <= 1 for n, a in enumerate(groups) for b in groups[:n])
    assert sorted(x for g in groups for x in g) == sorted([*range(15)] * 2)


def test_recall_in_crowded_families_of_many_classes(spark):
    """Bands with hundreds of lines in many classes, beside lines at the threshold: hardly a link is missed."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    lines = []
    for _ in range(3):
        head = letters(300)
        for _ in range(60):
            own = letters(50)
            lines += [head + own + letters(6), head + own + letters(6)]
    for _ in range(150):
        own = letters(208)
        lines += [own[:100] + "#" * 10 + own[110:], own]
    rng.shuffle(lines)
    texts = dict(enumerate(lines))
    found = {r["doc_id"]: r["removed"] for r in line_dedup.summary(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    wanted = brute(texts)
    assert sum(map(len, wanted.values())) == 330
    assert sum(len(wanted[i]) for i in texts if found[i] == wanted[i]) >= 0.98 * 330
    assert all(set(found[i]) <= set(wanted[i]) for i in texts)


def test_marks_leave_out_no_link_and_most_other_pairs(spark):
    """Candidates were all compared by their full sets."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    lines, pairs = [letters(5), "ab" * 900, "é\U0001f600" * 40], [(0, 1), (1, 2)]
    for k in range(300):
        own = letters(rng.randint(12, 700))
        cut = int(len(own) * (k % 10) / 20)
        lines += [own, own[: len(own) - cut] + letters(cut)]
        pairs.append((len(lines) - 2, len(lines) - 1))
    pool = spark.createDataFrame(list(enumerate(lines)), "h long, text string")
    found = {tuple(r) for r in line_dedup._possible(spark.createDataFrame(pairs, "a long, b long"), pool, 9, 80).collect()}
    sets = [shingles(x) for x in lines]
    links = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(links) > 60 and links <= found
    assert len(found - links) < 0.3 * (len(pairs) - len(links))


def test_clashing_columns_repeated_rows_and_long_lines(spark):
    rows = [(2, "a b c", 1, 2, 3, 4), (1, "a b c", 1, 2, 3, 4), (1, "a b c", 1, 2, 3, 4), (3, "x" * 200_000, 1, 2, 3, 4), (3, None, 1, 2, 3, 4), (None, "x" * 199_990 + "\n\ny", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, removed long, `gone.key` long, docs long")
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, len(r["text"] or ""), r["docs"]) for r in out.collect()) == [(0, 199_993, 4), (1, 5, 4), (1, 5, 4), (3, 0, 4)]


def test_the_set_of_a_long_line_takes_time_in_proportion(spark):
    """A line's units are not copied for each shingle, which took 80 GB of copies a set for 200,000 units and grew with
    the square of the line."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (9, 3000, 1_000_000)]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, text string").select("k", F.encode("text", "UTF-16BE").alias("units"))
    began = time.perf_counter()
    found = {r["k"]: r["n"] for r in rows.select("k", F.size(line_dedup._shingle_set(F.col("units"), 9)).alias("n")).collect()}
    assert found == {k: len(shingles(line)) for k, line in enumerate(lines)}
    assert time.perf_counter() - began < 60


def test_few_long_lines_are_looked_at_twice(spark):
    """A line of which one bin was empty by chance, one in 27, went through a second pass over all documents."""
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    lines = [(k, letters(300)) for k in range(2000)] + [(2000 + k, letters(12) * 30) for k in range(50)]
    least = line_dedup._least(spark.createDataFrame(lines, "h long, text string"), 9, line_dedup.DEPTH)
    weak = {r["id"] for r in line_dedup._signed(least).where("weak").collect()}
    assert {2000 + k for k in range(50)} <= weak and len(weak) < 50 + 10
