"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, union-find. DataFrame operations
only.

A line is what lies between \\n in a text. Its shingles are the runs of `width` UTF-16 units (a shorter line is one
shingle). Equal lines are one node; two different lines are linked when the Jaccard similarity of their shingle sets
reaches `percent` / 100. Of each class of lines linked in turn, the first occurrence by (doc_id, line) stays; blank
lines always stay and link nothing.

Signatures: each shingle's hash falls into one of BINS bins, each bin keeps its smallest hash, an empty bin takes over
the next full one's. The bins are the edges of the Petersen graph, and its nodes, with three edges each, are the bands
that make candidates; no two bands share more than one bin. Two lines of similarity 0.8 share a band with a probability
of 0.994 (0.9986 at 0.85), or 0.993 where their lengths differ by a fifth.

Edge cases: a null or empty text has one blank line; rows that agree in doc_id and text are one document and are
treated alike; a null doc_id comes first in the order; long lines count whole. Other columns are ignored, or kept
where documents are returned.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import leader_pairs, linked_groups, live_members
from .store import BROADCAST_ROWS, scratch, size, small, stored
from .text_columns import keyed

WIDTH, PERCENT = 9, 80
_NODES = [set(x) for x in combinations(range(5), 2)]
_EDGES = [(i, j) for i, j in combinations(range(len(_NODES)), 2) if not _NODES[i] & _NODES[j]]
#: The bins of each band.
BANDS = [[k for k, edge in enumerate(_EDGES) if i in edge] for i in range(len(_NODES))]
BINS = len(_EDGES)
#: Bands are dealt out in so many parts, one after the other: so much less lies in shuffle files at a time.
PARTS = 2
#: Shingles of a line that are looked at for each bin, about: those of smallest hash. A bin has none of them once in
#: 400 times, and only then may its value differ from that over all shingles.
DEPTH = 6
#: Bins of a long line that may have none of these. More have none once in 1,500 lines, or in a line that repeats itself,
#: and all shingles of such a line are looked at.
SPARE = 1
#: Different lines of an unsettled band that are all compared; in larger ones a prefix filter finds the pairs.
CROWD = 32
#: Members that are compared with one line in one task.
MEMBERS = 4096
#: Words of 64 bits in which the shingles of a line are marked.
WORDS = 16
BLANK = r"[^\x20\x09-\x0D]"


def _filled(line: Column) -> Column:
    """Whether a line is not blank. Most begin with what is no blank, which is cheaper to see."""
    return (F.ascii(line) > 32) | line.rlike(BLANK)


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, key, line, text, h) for each line of `rows` (doc_id, key, text) that is not blank."""
    lines = rows.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(_filled(F.col("text"))).withColumn("h", F.xxhash64("text"))


def _shingle(units: Column, at: Column, width: int) -> Column:
    """Hash of the shingle that begins at byte `at` (from 1) of UTF-16 units."""
    return F.xxhash64(F.substring(units, at, F.lit(2 * width)))


def _starts(units: Column, width: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(units) - (2 * width - 1)), F.lit(2))


def _shingle_set(units: Column, width: int) -> Column:
    """The different shingles of UTF-16 units. The units are bound to a variable of their own: a column of a row would be
    copied whole for each of its shingles."""
    every = F.transform(F.array(units), lambda own: F.transform(_starts(own, width), lambda at: _shingle(own, at, width)))
    return F.array_distinct(F.get(every, F.lit(0)))


def _least(lines: DataFrame, width: int, depth: int | None) -> DataFrame:
    """(h, n, b0, ...): each line's length and its bins' smallest values (31 bits); with `depth`, of the shingles whose
    hash is among the smallest of so many a bin by the line's length (null where a bin has none)."""
    units = lines.select("h", F.encode("text", "UTF-16BE").alias("units")).withColumn("n", (F.octet_length("units") / 2).cast("int"))
    limit = F.lit(1 << 31) if depth is None else F.floor(F.lit(float(BINS * depth << 31)) / F.col("n"))
    found = units.withColumn("limit", limit).select("h", "n", "limit", "units", F.explode(_starts(F.col("units"), width)).alias("at"))
    hashed = found.select("h", "n", "limit", "at", _shingle(F.col("units"), F.col("at"), width).alias("v"))
    w, low = F.shiftrightunsigned("v", 33), F.shiftrightunsigned("v", 33) <= F.col("limit")
    hashed = hashed.where(low | (F.col("at") == 1)).select("h", "n", F.when(low, w.cast("int")).alias("w"), F.pmod("v", F.lit(BINS)).cast("int").alias("bin"))
    return hashed.groupBy("h").agg(F.max("n").alias("n"), *(F.min(F.when(F.col("bin") == j, F.col("w"))).alias(f"b{j}") for j in range(BINS)))


def _signed(least: DataFrame) -> DataFrame:
    """(id, weak, b0, ...): 15 bits of each bin of `least`, an empty one as the next full one, and whether a long line has
    more than SPARE empty ones. Each bin takes over from the one after it, so that the generated code stays small enough to
    be compiled."""
    bins = [f"b{j}" for j in range(BINS)]
    weak = F.expr(f"n > {BINS * DEPTH} AND {' + '.join(f'int({b} IS NULL)' for b in bins)} > {SPARE}")
    rows = least.select(F.col("h").alias("id"), weak.alias("weak"), F.coalesce(*bins).alias(f"b{BINS}"), *bins)
    for j in reversed(range(BINS)):
        rows = rows.withColumn(bins[j], F.coalesce(bins[j], f"b{j + 1}"))
    return rows.select("id", "weak", *(F.col(b).bitwiseAND(0x7FFF).cast("short").alias(b) for b in bins))


def signatures(rows: DataFrame, places: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, b0, ...): a node for each different line of `rows`, with 15 bits of each bin's smallest hash.

    A first pass looks at the smallest hashes only; where it leaves bins empty (rarely, or in a line that repeats
    itself) a second one looks at all of the line's, and cuts only the documents that hold such a line."""
    first = stored(_signed(_least(_lines(rows), width, DEPTH)), "least")
    ids = stored(first.where("weak").select(F.col("id").alias("h")), "ids")
    if not size(ids):
        return first.drop("weak")
    ids = small(ids)
    keys = small(stored(places.join(ids, "h", "left_semi").select("place.key").distinct(), "keys"))
    again = _lines(rows.join(keys, "key", "left_semi")).join(ids, "h", "left_semi")
    return first.where("NOT weak").union(stored(_signed(_least(again, width, None)), "again")).drop("weak")


def _some_lines(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(h, text) of the different lines whose hash is in the stored table `ids`."""
    return lines.select("h", "text").join(small(ids), "h", "left_semi").groupBy("h").agg(F.max("text").alias("text"))


def _marks(lines: DataFrame, width: int) -> DataFrame:
    """(h, n, m0, ...): how many shingles begin in each line of `lines` (h, text), and the bits that their hashes mark."""
    units = lines.select("h", F.encode("text", "UTF-16BE").alias("units"))
    found = units.select("h", "units", F.explode(_starts(F.col("units"), width)).alias("at"))
    hashed = found.select("h", _shingle(F.col("units"), F.col("at"), width).alias("v"))
    hashed = hashed.select("h", F.expr(f"cast((v >> 6) & {WORDS - 1} AS int)").alias("word"), F.expr("shiftleft(1L, cast(v & 63 AS int))").alias("bit"))
    words = (F.coalesce(F.bit_or(F.when(F.col("word") == j, F.col("bit"))), F.lit(0).cast("long")).alias(f"m{j}") for j in range(WORDS))
    return hashed.groupBy("h").agg(F.count("*").alias("n"), *words)


def _possible(pairs: DataFrame, pool: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of lines of `pool` but for those whose marks show that they are no link. A bit that only one of
    them has is a shingle that only one of them has, and a link has at most 100 - percent of those for 100 + percent
    shingles of both."""
    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "ids")
    own = stored(_marks(pool.join(small(ids), "h", "left_semi"), width), "marks")
    own = F.broadcast(own) if size(own) * WORDS <= BROADCAST_ROWS else own
    rows = small(pairs)
    for end in "ab":
        rows = rows.join(own.select(F.col("h").alias(end), F.col("n").alias(f"n{end}"), *(F.col(f"m{j}").alias(f"{end}{j}") for j in range(WORDS))), end)
    differ = " + ".join(f"bit_count(a{j} ^ b{j})" for j in range(WORDS))
    return rows.where(f"{100 + percent} * ({differ}) <= {100 - percent} * (na + nb)").select("a", "b")


def bands(nodes: DataFrame) -> list[DataFrame]:
    """(bucket, id) of each node, in PARTS tables."""
    keys = [F.xxhash64(F.lit(k), *(f"b{j}" for j in bins)) for k, bins in enumerate(BANDS)]
    return [nodes.select(F.explode(F.array(*keys[k::PARTS])).alias("bucket"), "id") for k in range(PARTS)]


def line_classes(rows: DataFrame, places: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, component) of the lines of `rows` (doc_id, key, text), which lie at `places` (h, place), that are linked with a
    different line."""
    with scratch(rows.sparkSession) as keep:
        live, twos = live_members(bands(signatures(rows, places, width)), keep)
    met = live.select("id").union(twos.select("a")).union(twos.select("b")).distinct()
    pool = stored(_some_lines(_lines(rows), stored(met.toDF("h"), "met")), "pool")  # the lines that share a band with any

    def possible(pairs: DataFrame) -> DataFrame:
        return _possible(pairs, pool, width, percent)

    def verify(pairs: DataFrame) -> DataFrame:
        """The pair's line that occurs in more pairs is its head: its set is taken once, that of the other one as it is
        compared, so that sets are neither stored nor shuffled."""
        pairs = stored(pairs, "pairs")
        degree = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).groupBy("h").agg(F.count("*").alias("degree"))
        degree = stored(degree, "degree")
        a, b = (small(degree).toDF(end, f"by_{end}") for end in "ab")
        turned = F.when(F.col("by_a") >= F.col("by_b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = stored(pairs.join(a, "a").join(b, "b").select(turned.alias("p")).select("p.*"), "turned")
        heads = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks")), "heads")
        members = small(pairs).join(small(heads), "a").join(pool.withColumnRenamed("h", "b"), "b")
        members = members.select("a", "b", "text", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))
        units = F.encode("text", "UTF-16BE").alias("units")
        known = small(heads).join(pool.withColumnRenamed("h", "a"), "a").select("a", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), units)
        known = known.select("a", "block", _shingle_set(F.col("units"), width).alias("set_a"))
        met = members.select("a", "b", "block", units).join(known, ["a", "block"])
        met = met.select("a", "b", "set_a", _shingle_set(F.col("units"), width).alias("set_b"))
        met = met.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("n"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
        return met.where(f"100 * both >= {percent} * (n - both)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def tokens(ids: DataFrame) -> DataFrame:
        lines = pool.join(small(stored(ids.toDF("h"), "ids")), "h", "left_semi")
        units = lines.select(F.col("h").alias("id"), F.encode("text", "UTF-16BE").alias("units"))
        return units.select("id", F.explode(_shingle_set(F.col("units"), width)).alias("v"))

    return linked_groups(live, leader_pairs(live).union(twos), lambda pairs: pairs, verify, tokens, percent, CROWD, possible)


def hashed_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, key, hashes): the hash of each line of `rows` (doc_id, key, text), null for a blank one."""
    hashes = F.transform(F.split("text", "\n"), lambda x: F.when(_filled(x), F.xxhash64(x)))
    return rows.select("doc_id", "key", hashes.alias("hashes"))


def removals(rows: DataFrame, hashed: DataFrame | None = None, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, removed): the numbers of the lines that go, of each document of `rows` (doc_id, key, text) that loses any.
    `hashed` are the stored `hashed_lines` where there are any."""
    with scratch(rows.sparkSession) as keep:
        hashed = stored(hashed_lines(rows), "hashed") if hashed is None else hashed
        places = hashed.select("doc_id", "key", F.posexplode("hashes").alias("line", "h")).where("h IS NOT NULL")
        places = places.select("h", F.struct("doc_id", "key", "line").alias("place"))
        classes = stored(line_classes(rows, places, width, percent), "classes")
        heads = places.groupBy("h").agg(F.min("place").alias("first"), F.count("*").alias("times"))
        heads = heads.join(small(classes).withColumnRenamed("id", "h"), "h", "left").where("times > 1 OR component IS NOT NULL")
        heads = stored(heads.select("h", "first", F.coalesce("component", "h").alias("component")), "heads")
        best = heads.groupBy("component").agg(F.min("first").alias("best"))
        best = stored(heads.join(best, "component").select("h", "best"), "best")
        gone = places.join(small(best), "h").where(~F.col("place").eqNullSafe(F.col("best")))
        gone = gone.groupBy("place.key", "place.line").agg(F.count("*"))  # rows that repeat are one
        return keep(gone.groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("removed")), "removals")


def summary(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, removed (their numbers, from 0)."""
    rows = keyed(docs)
    hashed = stored(hashed_lines(rows), "hashed")
    n_lines = F.size(F.array_compact("hashes")).cast("long")
    out = hashed.select("doc_id", "key", n_lines.alias("n_lines")).join(removals(rows, hashed, width, percent), "key", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all columns, with the removed lines taken out of `text`; rows that lose nothing are as they
    were, and a row that loses all its lines goes."""
    gone = small(removals(keyed(docs), None, width, percent)).alias("gone")
    key = F.xxhash64(F.col("docs.doc_id").cast("long"), F.coalesce(F.col("docs.text").cast("string"), F.lit("")))
    rows = docs.alias("docs").join(gone, key == F.col("gone.key"), "left")
    left = F.filter(F.split("docs.text", "\n"), lambda x, i: ~F.array_contains("gone.removed", i))
    text = F.when(F.col("gone.removed").isNull(), F.col("docs.text")).otherwise(F.array_join(left, "\n"))
    rows = rows.where(F.col("gone.removed").isNull() | text.rlike(BLANK))
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"docs.`{c}`") for c in docs.columns))
