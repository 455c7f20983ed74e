"""Phrase collocations by language: all n-grams as rows, hash-aggregated, scored against their parts in exact decimals.

A text is lower-cased (A-Z only), cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`. f(phrase)
counts all places of a phrase within pieces, by language. A candidate has 2 to `most` words and f >= `least`. Cut after
its first k words, with l and r the counts of the two parts, it scores floor(1,000,000 * a * a / (l * r)); the cut of
lowest score counts, the first of several. A candidate that lies in a longer one with f(longer) >= `inside` percent of its
own is dropped. Looking at candidates of one word more is enough: between a phrase and a longer one around it, counts
only fall. Of each language the first `top` remain.

Words and pairs are counted in one pass, each further length in one of its own, so that the shuffle files of one pass
lie on disk at a time; each task counts what it has before it shuffles. Parts of a candidate occur at least as often as
it does, so only n-grams of `least` places and more are stored. A part that very many candidates share is dealt out to
blocks in the join, and the ranking takes the best of SALTS shares of a language before those of the language.

Edge cases: a null or empty text has no words; a null language is `und`, together with a language of that name; rows
that repeat count each; ties in score go by count, then by the phrase's UTF-8 bytes; an empty table gives an empty result;
a language without candidates gives no row. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import scratch, small, stored
from .text_columns import ascii_lower, words_between

MOST, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: What separates pieces.
PIECE = r"[.,;:!?\x0A-\x0D]"
#: Candidates with the same part that one task looks up; shares of a language in its ranking.
BLOCK, SALTS = 100_000, 32


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, words) of each piece that has a word. Splitting at one character needs no regular expression."""
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, PIECE)).alias("piece"))
    return rows.select("lang", words_between(F.replace("piece", F.lit("\t"), F.lit(" ")), " ").alias("words")).where(F.size("words") > 0)


def grams(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(lang, phrase, words): a row for each place of so many words in a piece, for each of `lengths`."""
    most = max(lengths)
    shifted = F.arrays_zip(*(F.slice("words", k + 1, F.size("words")).alias(f"w{k}") for k in range(most)))
    word = lambda k: F.col("z")[f"w{k}"]
    spaced = lambda n: F.concat(word(0), *(x for k in range(1, n) for x in (F.lit(" "), word(k))))
    places = rows.select("lang", F.explode(shifted).alias("z"))
    if len(lengths) == 1:
        return places.select("lang", spaced(most).alias("phrase"), F.lit(most).alias("words")).where("phrase IS NOT NULL")
    each = F.explode(F.array(*(F.struct(spaced(n).alias("phrase"), F.lit(n).alias("words")) for n in lengths))).alias("x")
    return places.select("lang", each).select("lang", "x.*").where("phrase IS NOT NULL")


def counted(docs: DataFrame, most: int = MOST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of the phrases of 1 to `most` words with f >= `least`, and (lang, n) with all words."""
    rows, found = pieces(docs), []
    for lengths in [[1, 2], *([n] for n in range(3, most + 1))]:
        own = grams(rows, lengths).groupBy("lang", "phrase", "words").agg(F.count("*").alias("f"))
        found.append(stored(own.where((F.col("f") >= least) | (F.col("words") == 1)), "grams"))
    counts = reduce(DataFrame.unionByName, found)
    totals = stored(found[0].where("words = 1").groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    return counts.where(F.col("f") >= least), totals


def _with_count(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """`cuts` with the count of the phrase in column `part`. Parts that many rows share are dealt out to blocks."""
    load = cuts.groupBy("lang", part).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    load = small(stored(load.where("blocks > 1"), "load"))
    keys = ["lang", part]
    spread = cuts.join(load, keys, "left").withColumn("block", F.pmod(F.xxhash64("phrase"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    known = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).join(load, keys, "left")
    known = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return spread.join(known, [*keys, "block"]).drop("block")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1,000,000 * a * a / (l * r)) in decimals of 38 digits: exact for counts of up to 10^15."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", whole(a) * whole(a) * F.lit(1_000_000).cast("decimal(7,0)"), whole(l) * whole(r))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of `counts` (lang, phrase, words, f) with two or more words,
    whose parts must be there too."""
    words = F.split("phrase", " ")
    cuts = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " "))
    cuts = _with_count(_with_count(cuts, counts, "first", "l"), counts, "rest", "r").withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    found = cuts.groupBy("lang", "phrase", "words", "a").agg(lowest)
    return found.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def not_inside(phrases: DataFrame, inside: int = INSIDE) -> DataFrame:
    """`phrases` (lang, phrase, words, a, ...) without those inside one of theirs of one word more that is frequent enough."""
    words, ends = F.split("phrase", " "), F.col("words") - 1
    shorter = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), ends), " "), F.array_join(F.slice(words, F.lit(2), ends), " ")))
    longer = phrases.where("words > 2").select("lang", "a", shorter.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """`phrases` with their rank by language, the first `top` of each."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = phrases.withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("place") <= top)
    return best.drop("place").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` collocations of each language, with their count, those of the
    parts of the cut that counts, and the words of the language."""
    with scratch(docs.sparkSession) as keep:
        counts, totals = counted(docs, most, least)
        found = ranked(not_inside(stored(scored(counts), "scored"), inside), top)
        found = found.join(small(totals), "lang")
        return keep(found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
