"""Links between nodes, and the classes that they join: candidates, an exact prefix filter, union-find as Spark rounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, scratch, size, small, stored

#: Candidates between two classes that are verified in each turn: the last one takes all that are left.
QUOTAS = (1, 12, None)
#: Members of a shared token that one task compares with others at a time, about.
BLOCK = 512
#: Turns in which sets of crowded buckets are compared with leaders of their rare members, and leaders for each; the turns
#: end when fewer than one in 1 / WORTH pairs is a link.
TURNS, STARS, WORTH = 6, 4, 0.02
#: Parts of the rare members, one of which is looked up in each turn.
SLICES = 2


def ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The different pairs (a, b), a < b."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node reachable over `edges` (a, b), for every node that has an edge.

    Alternating star contraction: each round hooks the neighbours of a node to the smallest of them, and the rounds
    end when no edge changes, after a number that grows with the logarithm of the nodes. A node with very many
    neighbours is met by aggregates with partial sums and by joins that can be split, never by a gathered list.
    """
    with scratch(edges.sparkSession) as keep:
        edges, mark = _measured(ordered(edges, "a", "b"))
        while True:
            # a node has one row in what is joined, and there are at most two nodes an edge
            one = F.broadcast if 2 * mark["n"] <= BROADCAST_ROWS else lambda t: t
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = edges.join(one(least), "a").select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b")).where("a < b")
            down = large.groupBy("b").agg(F.min("a").alias("m"))
            joined = large.join(one(down), "b").select(F.col("a").alias("x"), F.col("m").alias("y"))
            edges, now = _measured(ordered(joined.union(down.select("b", "m")), "x", "y"))
            if now == mark:
                break
            mark = now
        stars = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
        return keep(stars.union(edges.select("a", "a").distinct()), "classes")


def _measured(edges: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """The stored edges, with their number and a checksum that are counted as they are written."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    out = stored(edges.observe(seen, checksum.alias("checksum")), "edges")
    return out, {"n": size(out)} | seen.get


def united(classes: DataFrame, links: DataFrame) -> DataFrame:
    """`classes` (id, component) after further `links` (a, b): only the links between classes are contracted again."""
    known = small(classes)
    with scratch(links.sparkSession) as keep:
        new = links
        for end in "ab":
            own = known.select(F.col("id").alias(end), F.col("component").alias("c"))
            new = new.join(own, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        moved = small(components(new)).toDF("component", "to")
        changed = classes.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        fresh = moved.select(F.col("component").alias("id"), F.col("to").alias("component"))
        return keep(changed.union(fresh.join(known.select("id"), "id", "left_anti")), "classes")


def live_members(parts: list[DataFrame], keep: Callable[[DataFrame, str], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """(bucket, id, size) of the buckets with more than two members, and the pairs (a, b) of those with two, from
    tables of (bucket, id) that are dealt out one after the other. A bucket with one member never leaves its count. `keep`
    stores both."""
    live, twos = [], []
    for part in parts:
        sizes = part.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("a"), F.max("id").alias("b"))
        sizes = keep(sizes.where("size > 1"), "sizes")
        twos.append(sizes.where("size = 2").select("a", "b"))
        live.append(keep(part.join(small(sizes.where("size > 2").select("bucket", "size")), "bucket"), "live"))
    return reduce(DataFrame.union, live), reduce(DataFrame.union, twos)


def leader_pairs(live: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's leader, the member that meets most others over all its buckets
    (the hub of a group of copies, where there is one)."""
    score = live.groupBy("id").agg(F.sum("size").alias("score"))
    best = F.max(F.struct("score", (-F.col("id").cast("decimal(20,0)")).alias("low"), "id"))["id"]
    leaders = stored(live.join(score, "id").groupBy("bucket").agg(best.alias("leader")), "leaders")
    return live.join(small(leaders), "bucket").select(F.col("id").alias("a"), F.col("leader").alias("b"))


def prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """(v, id, n, pos): the rarest members v of each set of `tokens` (id, v), with their place and the set's size, among
    which two sets whose Jaccard similarity reaches `percent` / 100 share one.

    The members of each set are ordered from the rarest to the most frequent, so that what most sets of a family have in
    common is hardly ever looked up."""
    times = tokens.groupBy("v").agg(F.count("*").alias("f"))
    own = Window.partitionBy("id")
    ranked = tokens.join(times, "v").withColumn("pos", F.row_number().over(own.orderBy("f", "v"))).withColumn("n", F.count("*").over(own))
    return ranked.where(f"f > 1 AND pos <= n - ({percent} * n + 99) div 100 + 1").select("v", "id", "n", "pos")


def _classed(probe: DataFrame, classes: DataFrame) -> DataFrame:
    return probe.join(small(classes).select("id", F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))


def star_pairs(probe: DataFrame, classes: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each set with the leaders of its rare members that belong to other classes, STARS of them at most, those of
    most of its rare members first. So there are at most STARS pairs for each set, however large a family is. The leader
    of a member is one of the sets that have it, in each turn another one. A turn looks up one member in SLICES."""
    rows = _classed(probe.where(F.pmod(F.xxhash64("v"), F.lit(SLICES)) == turn % SLICES), classes)
    leaders = rows.groupBy("v").agg(F.min(F.struct(F.xxhash64("id", "v", F.lit(turn)).alias("h"), "id", "c", "n")).alias("x"), F.min("c").alias("low"), F.max("c").alias("high"))
    leaders = stored(leaders.where("low < high").select("v", F.col("x.id").alias("leader"), F.col("x.c").alias("lc"), F.col("x.n").alias("ln")), "leaders")
    met = rows.join(small(leaders), "v").where("c <> lc").where(f"100 * n >= {percent} * ln AND 100 * ln >= {percent} * n")
    shared = met.groupBy("id", "leader").agg(F.count("*").alias("shared"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), F.xxhash64("id", "leader", F.lit(turn)), "leader"))
    return ordered(shared.withColumn("rank", best).where(F.col("rank") <= STARS), "id", "leader")


def prefix_pairs(probe: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared): pairs of sets of different classes among which are all whose Jaccard similarity reaches
    `percent` / 100, from their rarest members, with the number of those that they share. With the rank of the first
    shared one the size of the intersection is bounded. A member that very many sets share is dealt out to blocks."""
    probe = _classed(probe, classes)
    index = probe.where(f"pos <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    load = index.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    load = stored(load.where("blocks > 1"), "load")
    index, probe = (rows.join(small(load), "v", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) for rows in (index, probe))
    x = index.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).alias("x")
    y = probe.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).alias("y")
    met = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.block") == F.col("y.block")) & F.expr("x.c <> y.c AND (x.n < y.n OR (x.n = y.n AND x.id < y.id))"))
    fits = f"100 * x.n >= {percent} * y.n AND {100 + percent} * (1 + least(x.n - x.pos, y.n - y.pos)) >= {percent} * (x.n + y.n)"
    met = met.where(fits).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"))


def linked_groups(
    live: DataFrame,
    tried: DataFrame,
    near: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    tokens: Callable[[DataFrame], DataFrame],
    percent: int,
    crowd: int,
    possible: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> DataFrame:
    """(id, component) of the nodes that have a verified link. Nodes that share a bucket of `live` (bucket, id, size) are
    candidates. `near` leaves of the pairs (a, b) in `tried` those worth a comparison, `verify` those that hold. Of the further
    candidates `possible` may leave out those that are certain to be no links.

    No bucket is expanded into its pairs. First the pairs of `tried` are verified, a few for each member. A bucket whose
    members are then all in one class is settled. In the others, and only there, members of different classes are
    candidates too: all of them in a bucket of at most `crowd` members; those of larger ones by a prefix filter over their
    sets, which misses no link. Before it, in a few turns, each set meets a few leaders of its rare members, which joins
    most of a family at a cost in proportion to its size. `tokens` gives the (id, v) of nodes (id). Of the candidates between two classes those
    that have most in common are verified first, and only if they leave the classes apart do the others follow, to the
    last one.
    """
    tried = stored(ordered(tried, "a", "b"), "tried")
    with scratch(live.sparkSession) as keep:
        links = keep(verify(near(tried)), "links")
    classes = components(links)
    placed = live.join(small(classes), "id", "left").select("bucket", "id", "size", F.coalesce("component", "id").alias("c"))
    open_ = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    rest = stored(placed.join(small(stored(open_, "open")), "bucket", "left_semi"), "rest")
    few = rest.where(F.col("size") <= crowd)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") < F.col("y.c")))
    pairs = pairs.groupBy(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).agg(F.count("*").alias("shared"))
    crowded = stored(rest.where(F.col("size") > crowd).select("id").distinct(), "crowded")
    probe = None
    if size(crowded):
        with scratch(live.sparkSession) as keep:
            probe = keep(prefixes(stored(tokens(crowded), "tokens"), percent), "probe")
        for turn in range(TURNS):
            with scratch(live.sparkSession) as keep:
                met = keep(star_pairs(probe, classes, turn, percent).join(tried, ["a", "b"], "left_anti"), "met")
            if not size(met):
                break
            tried = stored(tried.union(met), "tried")
            with scratch(live.sparkSession) as keep:
                more = keep(verify(near(possible(met))), "more")
            classes = united(classes, more) if size(more) else classes
            if size(more) < size(met) * WORTH:
                break
    with scratch(live.sparkSession) as keep:
        if probe is not None:
            pairs = pairs.union(prefix_pairs(probe, classes, percent))
        pairs = pairs.groupBy("a", "b").agg(F.max("shared").alias("shared")).join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "found")
        pairs = keep(pairs.join(possible(pairs.select("a", "b")), ["a", "b"], "left_semi"), "candidates")
    done = tried.limit(0)
    for quota in QUOTAS:
        between = _between(pairs, classes)
        if quota:
            of_two = Window.partitionBy("ca", "cb").orderBy(F.desc("shared"), "a", "b")
            between = between.withColumn("rank", F.row_number().over(of_two)).where(F.col("rank") <= quota)
        between = stored(between.select("a", "b").join(small(done), ["a", "b"], "left_anti"), "between")
        if not size(between):
            break
        done = stored(done.union(between), "done")
        with scratch(live.sparkSession) as keep:
            more = keep(verify(between), "more")
        classes = united(classes, more) if size(more) else classes
    return classes


def _between(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, shared, ca, cb): the pairs whose ends are in different classes, with these in order."""
    classes = small(classes)
    for end in "ab":
        own = classes.select(F.col("id").alias(end), F.col("component").alias("c"))
        pairs = pairs.join(own, end, "left").withColumn(f"c{end}", F.coalesce("c", end)).drop("c")
    pairs = pairs.where("ca <> cb")
    return pairs.select("a", "b", "shared", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
