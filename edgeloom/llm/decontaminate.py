"""Benchmark decontamination by winnowing: DataFrame operations only.

Texts are lower-cased (A-Z only) and cut into words of letters and digits. A window is `window` consecutive words of
a benchmark item (an item of fewer words, but not none, is one window). A word of a document is hit when it lies in
an occurrence of a window.

Winnowing: of every run of `window - gram + 1` neighbouring word k-grams, a text keeps the smallest hash, so two texts
that share a window share a kept hash. Documents and items that share one are extended: the documents' windows meet
the item's windows in full. Items too short for a window have windows of their own length and meet every run of that
length. Equality is that of 64-bit hashes.

Edge cases: a null or empty document has no words and is clean; a null or empty item has no window; an item whose
item_id is null hits words but is not counted; rows that repeat are each returned; a null doc_id is kept. Other columns
are ignored. Fingerprints of the benchmark are broadcast only behind a count of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small, stored
from .text_columns import NOT_ALNUM, NOT_ALNUM_ANY, ascii_lower, keyed, rolling, words_between

WINDOW, GRAM = 10, 5


def _hashed(docs: DataFrame) -> DataFrame:
    """The hashes of the words, in place of the text."""
    words = words_between(ascii_lower(F.col("text")), NOT_ALNUM)
    return docs.withColumn("words", words).withColumn("words", F.transform("words", lambda w: F.xxhash64(w))).drop("text")


def _runs(length: int) -> Column:
    """Hashes of every `length` neighbouring words; runs of different lengths differ."""
    return rolling("words", length, lambda *w: F.xxhash64(F.lit(length), *w))


def _marked(hashed: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """With the distinct fingerprints of each row, for windows of every length: the winnowed k-gram hashes for `window`,
    all runs for a shorter one."""
    runs = hashed.withColumn("grams", _runs(gram)) if window in lengths else hashed
    marks = (rolling("grams", window - gram + 1, F.least) if n == window else _runs(n) for n in lengths)
    return runs.withColumn("mark", F.explode(F.array_distinct(F.concat(*marks)))).drop("words", "grams")


def _places(hashed: DataFrame, lengths: list[int]) -> DataFrame:
    """(length, first, mark) of each run of words of these lengths."""
    def places_of(n: int) -> Column:
        return F.transform(_runs(n), lambda m, i: F.struct(F.lit(n).alias("length"), i.alias("first"), m.alias("mark")))

    places = map(places_of, lengths)
    return hashed.withColumn("place", F.explode(F.concat(*places))).drop("words").select("*", "place.*").drop("place")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, first, length, item_id): each occurrence of a window of an item in a row of `docs` (key, text). The texts
    are read once for the fingerprints of all lengths, and those that share one once more."""
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = stored(_hashed(items).withColumn("n", F.least(F.size("words"), F.lit(window))).where("n > 0"), "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most `window` numbers
    if not lengths:
        return docs.where("false").select("key", F.lit(0).alias("first"), F.lit(0).alias("length"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"))
    own = lambda n: items.where(F.col("n") == n).select("item_id", "words")
    marks = reduce(DataFrame.union, (_marked(own(n), [n], window, gram).select("mark") for n in lengths))
    marks = small(stored(marks.distinct(), "marks"))
    texts = docs.select("key", "text")
    found = _marked(_hashed(texts), lengths, window, gram).join(marks, "mark", "left_semi")
    candidates = small(stored(found.select("key").distinct(), "candidates"))
    spans = reduce(DataFrame.union, (_places(own(n), [n]).drop("first") for n in lengths))
    spans = small(stored(spans.distinct(), "windows"))
    near = _hashed(texts.join(candidates, "key", "left_semi").dropDuplicates(["key"]))
    return stored(_places(near, lengths).join(spans, ["length", "mark"]).select("key", "first", "length", "item_id"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (item_ids as strings, sorted)."""
    rows = keyed(docs)
    found = hits(rows, benchmark, window, gram)
    spots = found.select("key", "first", "length").distinct()
    spots = spots.select("key", F.explode(F.expr("sequence(first, first + length - 1)")).alias("at")).distinct()
    counts = spots.groupBy("key").agg(F.count("*").alias("n_hit"))
    items = found.select("key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    base = rows.select("key", "doc_id", F.size(words_between(F.col("text"), NOT_ALNUM_ANY)).cast("long").alias("n_words"))
    out = base.join(counts.join(items, "key"), "key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        items.alias("items"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of `docs`, all columns, in which no word is hit."""
    found = stored(hits(keyed(docs), benchmark, window, gram).select("key").distinct(), "hit")
    key = F.xxhash64(F.col("docs.doc_id").cast("long"), F.coalesce(F.col("docs.text").cast("string"), F.lit("")))
    return docs.alias("docs").join(small(found).alias("hit"), key == F.col("hit.key"), "left_anti")
