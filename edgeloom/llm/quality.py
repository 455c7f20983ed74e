"""Quality rules: counts of a text, and a log-likelihood ratio of hashed n-grams. DataFrame operations only.

Two multinomials over hashed word unigrams and bigrams are compared: that of the trusted documents (labelled good)
and that of the raw corpus, all documents. A document's score is the mean log-ratio of its n-grams, so it does not
depend on length; a document is kept when no base rule fails and the score reaches a fixed threshold.

Edge cases: a null, empty or blank text has no words and fails the base rules; without any trusted document every
score is 0; rows that repeat are each returned; a null doc_id is kept (and never trusted); a label row with a null
counts for nothing, and a document is trusted if any of its label rows is good. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small, stored
from .text_columns import SPACE, rolling, words_between

BUCKETS = 1 << 16
#: Mean log-ratio that a document needs; weight of the prior in a bucket; trusted documents that are counted, about,
#: at most (chosen by a hash of doc_id): bounds what is broadcast.
THRESHOLD, PRIOR, MAX_TRUSTED = -0.1, 1.0, 50_000
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = r"[#*$%&|<>]"


def _hashed(rows: DataFrame) -> DataFrame:
    """Instead of the text: n_words, word_chars and h, the hashes of its words in order."""
    rows = rows.withColumn("words", words_between(F.col("text"), SPACE))
    return rows.select(
        *(c for c in rows.columns if c not in ("text", "words")),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )


def _buckets() -> Column:
    """A row for each unigram and bigram of `h`; one with null where there is none."""
    return F.explode_outer(F.concat("h", rolling("h", 2, F.xxhash64)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def weights(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """(bucket, weight): the log-ratio of a bucket's frequency in the trusted documents to that in all documents."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    share = int(min(1.0, max_trusted / max(1, good.count())) * (1 << 30))
    good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).withColumn("good", F.lit(1))
    rows = _texts(docs).join(F.broadcast(good), "doc_id", "left")
    grams = _hashed(rows).select("good", _buckets().alias("gram")).where("gram is not null")
    counts = grams.groupBy(F.pmod("gram", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("good").alias("trusted"), F.count("*").alias("raw"))
    counts = stored(counts, "counts")
    total = counts.agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw")).first()
    if not total["trusted"]:
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    part = lambda name: (F.col(name) + PRIOR) / (total[name] + PRIOR * BUCKETS)
    return counts.select("bucket", F.log(part("trusted") / part("raw")).alias("weight"))


def _repeated(rows: DataFrame) -> DataFrame:
    """n_repeat_words in place of `h`: words in 3-word windows that occur twice or more.

    The window hashes of a text are sorted with their places in the low bits; equal neighbours name the places."""
    rows = rows.withColumn("t", rolling("h", 3, F.xxhash64)).drop("h")
    rows = rows.withColumn("low", F.expr("shiftleft(1L, length(bin(size(t)))) - 1L"))
    packed = F.transform("t", lambda x, i: x.bitwiseAND(F.bitwise_not("low")).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("packed", F.sort_array(packed))

    def same(i: Column, k: Column) -> Column:
        x, y = F.get("packed", i), F.get("packed", k)
        place = lambda p: p.bitwiseAND(F.col("low")).cast("int")
        alike = (x.bitwiseXOR(y).bitwiseAND(F.bitwise_not("low")) == 0) & (F.get("t", place(x)) == F.get("t", place(y)))
        return F.coalesce(alike, F.lit(False))

    every = F.when(F.size("packed") > 1, F.sequence(F.lit(0), F.size("packed") - 1)).otherwise(F.array().cast("array<int>"))
    found = F.filter(every, lambda i: same(i, i - 1) | same(i, i + 1))
    rows = rows.withColumn("at", F.sort_array(F.transform(found, lambda i: F.get("packed", i).bitwiseAND(F.col("low")))))
    gaps = F.aggregate(rolling("at", 2, lambda a, b: F.least(b - a, F.lit(3).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.when(F.size("at") > 0, gaps + 3).otherwise(F.lit(0).cast("long"))).drop("t", "low", "packed", "at")


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    table = weights(docs, labels)
    rows = _texts(docs).withColumn("row", F.monotonically_increasing_id())
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("row", "doc_id", "text", (F.size(F.split("text", SYMBOLS)) - 1).cast("long").alias("n_symbols"), lines.alias("lines"))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    base = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    hashed = _hashed(rows).select(*base, "h", F.col("h").alias("grams"))
    counted = _repeated(hashed).withColumnRenamed("grams", "h")
    base.append("n_repeat_words")
    grams = counted.select(*base, _buckets().alias("gram")).withColumn("bucket", F.pmod("gram", F.lit(BUCKETS)).cast("int"))
    scored = grams.join(F.broadcast(table), "bucket", "left").groupBy(*base).agg(F.coalesce(F.avg("weight"), F.lit(0.0)).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return out.select(*base[1:], "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that are kept; rows with the same doc_id stay together if any of them is kept."""
    good = stored(verdicts(docs, labels, threshold).where("kept").select("doc_id").distinct(), "good")
    return docs.alias("docs").join(small(good).alias("good"), F.col("docs.doc_id").cast("long").eqNullSafe(F.col("good.doc_id")), "left_semi")
