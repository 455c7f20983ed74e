"""Column expressions on texts that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters and digits (everything above ASCII counts as one), in lower case and in any text.
NOT_ALNUM, NOT_ALNUM_ANY = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"


def words_between(text: Column, separators: str) -> Column:
    """The words of a text. Splitting costs a fraction of extracting every match."""
    return F.array_remove(F.split(text, separators), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; a text of ASCII only takes the shorter way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and key, a hash of both: rows that agree in both share it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def rolling(array: str, k: int, f) -> Column:
    """f of every k neighbours of the array in column `array`. The column is named k times, not held in a slice, so
    that the optimiser keeps it as one computed column."""
    last = F.size(array) - k
    every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda i: f(*(F.get(array, i + j) for j in range(k))))
