"""Substring deduplication with sparse suffix arrays.

Texts are cut into words `[^\\x20\\x09-\\x0D]+`. Of the suffixes of all texts only those are retained that begin at a
minimiser: the word run of GRAM words with the smallest hash among the runs of some `window` consecutive words. Two
occurrences of the same `window` words retain the same suffixes, whatever surrounds them. The retained suffixes are
sorted over the whole corpus by their words; the common prefixes of neighbours tell which suffixes agree to the right,
and a match is extended to the left as far as it needs for `window` words. Of two occurrences the later one by
(doc_id, position) is to go. Suffixes whose first run of words is found nowhere else leave before the sort.

The sort deals the suffixes out in ranges of about TASK_ROWS that never part suffixes with the same first run. A run
with more suffixes than that is left out of it: they are matched by the hashes of their windows instead, in aggregates
with partial sums. Words are compared by 32 bits of their hash, first runs and windows by 64.

Edge cases: a null, empty or blank text, or one of fewer words than a window, has no repeat; repeats within one text
count; rows that agree in doc_id and text are one document and are treated alike; a null doc_id comes first in the
order; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import scratch, size, small, small_batches, stored
from .text_columns import keyed
from .words import SPACED, blocks, grams, hashed_words, mix

WINDOW, GRAM = 50, 8
#: Rows of a sorted task, about; rows that are matched at a time, unless more share their first words.
TASK_ROWS, CHUNK = 50_000, 4_000


def minimisers(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a block of texts whose words begin at `first`: the retained positions in order, the hash of each one's run,
    and how many words the windows that retain it begin before it, at least and at most (and any number between)."""
    none = np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(text[: len(words) - window + 1] == text[window - 1 :]) if len(words) >= window else none
    if not len(starts):
        return none, none.view(np.uint64), none, none
    runs = grams(words, gram)
    least = np.lib.stride_tricks.sliding_window_view(runs, window - gram + 1)
    left = np.concatenate([least[starts[k : k + 20_000]].argmin(1) for k in range(0, len(starts), 20_000)])
    at, begin, size = np.unique(starts + left, return_index=True, return_counts=True)
    return at, runs[at], left[begin + size - 1], left[begin]


def heads(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, key, n_words, heads (the hash of each retained suffix's first run)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(2)):
                words, first, _, _ = hashed_words(data, offsets, SPACED)
                at, runs, _, _ = minimisers(words, first, window, gram)
                cut = np.searchsorted(at, first)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(runs.view(np.int64)))
                part = batch.slice(a, b - a)
                columns = [part.column(0), part.column(1), pa.array(np.diff(first), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "heads"])

    return rows.select("doc_id", "key", "text").mapInArrow(parse, "doc_id long, key long, n_words long, heads array<long>")


SUFFIX = "head long, right_words binary, left_words binary, low_left int, high_left int, doc_id long, key long, at long"


def suffixes(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The retained suffixes of `rows` (doc_id, key, text, wanted) whose head is wanted, with the words from there on
    and those before, nearest first."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            for a, b, data, offsets in blocks(batch.column(2)):
                words, first, _, _ = hashed_words(data, offsets, SPACED)
                at, runs, low, high = minimisers(words, first, window, gram)
                cut = np.searchsorted(at, first)
                take = np.zeros(len(at), bool)
                for k in range(b - a):
                    take[cut[k] : cut[k + 1]] = np.isin(runs[cut[k] : cut[k + 1]], wanted[a + k].values.to_numpy().view(np.uint64))
                at, runs, low, high = (x[take] for x in (at, runs, low, high))
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                short = np.concatenate([np.zeros(window, np.uint32), (words >> np.uint64(32)).astype(np.uint32), np.zeros(window, np.uint32)])
                right = short[at[:, None] + window + np.arange(window)].astype(">u4")
                left = short[at[:, None] + window - 1 - np.arange(window - gram)].astype(">u4")
                fixed = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                ids = [batch.column(c).slice(a, b - a).take(pa.array(row)) for c in (0, 1)]
                columns = [pa.array(runs.view(np.int64)), fixed(right), fixed(left), pa.array(low, pa.int32()), pa.array(high, pa.int32())]
                columns += [*ids, pa.array(at - first[row])]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SUFFIX.split(", ")])

    return rows.select("doc_id", "key", "text", "wanted").mapInArrow(parse, SUFFIX)


MARK = ("key", "low", "high", "later_low", "later_high")


def _matrix(column: pa.Array) -> np.ndarray:
    """The 32-bit words in a binary column of one width."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], ">u4")[offsets[0] // 4 : offsets[-1] // 4].reshape(len(column), -1).astype(np.uint32)


class Sorted:
    """Suffixes in order, as arrays."""

    def __init__(self, rows: pa.RecordBatch, window: int) -> None:
        column = lambda name: rows.column(rows.schema.get_field_index(name))
        self.window = window
        self.right, self.left = _matrix(column("right_words")), _matrix(column("left_words"))
        self.head, self.low, self.high, self.key, self.at = (column(c).to_numpy() for c in ("head", "low_left", "high_left", "key", "at"))
        self.doc = column("doc_id").fill_null(-(1 << 62)).to_numpy()

    @staticmethod
    def joined(parts: list[Sorted]) -> Sorted:
        out = Sorted.__new__(Sorted)
        out.__dict__ = {k: np.concatenate([p.__dict__[k] for p in parts]) if isinstance(v, np.ndarray) else v for k, v in parts[0].__dict__.items()}
        return out

    def __len__(self) -> int:
        return len(self.at)

    def part(self, rows: np.ndarray) -> Sorted:
        out = Sorted.__new__(Sorted)
        out.__dict__ = {k: v[rows] if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return out

    def extended(self) -> Iterator[np.ndarray]:
        """Hashes of the nearest 0, 1, ... words to the left."""
        hashes = np.zeros(len(self), np.uint64)
        yield hashes
        for k in range(self.left.shape[1]):
            hashes = mix(hashes + self.left[:, k] + np.uint64(1))
            yield hashes

    def marks(self) -> dict[str, np.ndarray]:
        """MARK of the suffixes that match another: the words of any match and those of a match with an earlier one."""
        n = len(self)
        differ = self.right[1:] != self.right[:-1]
        prefix = np.where(differ.any(1), differ.argmax(1), self.right.shape[1])
        prefix[self.head[1:] != self.head[:-1]] = 0
        place, order = np.empty(n, np.int64), np.lexsort((self.at, self.key, self.doc))
        place[order] = np.cumsum(np.append(0, np.any([np.diff(c[order]) != 0 for c in (self.at, self.key, self.doc)], axis=0)))[:n]
        if not n:
            return {c: place for c in MARK}
        reach = np.zeros((4, n), np.int64)  # words to the left and to the right, in any match and in the later role
        for left, hashes in enumerate(self.extended()):
            right = self.window - left
            class_ = np.concatenate([[0], np.cumsum(prefix < right)]).astype(np.uint64)
            rows = np.flatnonzero((self.low <= left) & (left <= self.high))
            name = mix(hashes[rows] + class_[rows] * np.uint64(0x9E3779B97F4A7C15))
            rows = rows[np.argsort(name, kind="stable")]
            name.sort()
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(rows) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(rows)))
            if not (size > 1).any():
                continue
            earliest, latest = (np.repeat(f.reduceat(place[rows], first), size) for f in (np.minimum, np.maximum))
            met = earliest < latest
            for base, own in ((0, rows[met]), (2, rows[met & (place[rows] > earliest)])):
                reach[base, own] = np.maximum(reach[base, own], left)
                reach[base + 1, own] = np.maximum(reach[base + 1, own], right)
        hit = reach[1] > 0
        spans = (self.key, self.at - reach[0], self.at + reach[1], self.at - reach[2], self.at + reach[3])
        return {c: v[hit] for c, v in zip(MARK, spans, strict=True)}

    def windows(self) -> Iterator[dict[str, np.ndarray]]:
        """The hash of each window that retains a suffix, with its place."""
        for left, hashes in enumerate(self.extended()):
            rows = np.flatnonzero((self.low <= left) & (left <= self.high))
            name = hashes[rows] + np.uint64(left)
            for k in range(self.window - left):
                name = mix(name + self.right[rows, k] + np.uint64(1))
            yield {"hash": name.view(np.int64), "doc": self.doc[rows], "key": self.key[rows], "low": self.at[rows] - left}


def marks(found: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """MARK rows of the suffixes in `found` that match another one; `hot` are the heads of too many of them."""
    hot = small(stored(hot, "hot"))
    rest = found.join(hot, "head", "left_anti")
    tasks = max(1, min(size(found) // TASK_ROWS, 1 << 15))
    spread = rest.repartitionByRange(tasks, "head").sortWithinPartitions("head", "right_words", "doc_id", "key", "at")

    def sorted_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held: list[Sorted] = []
        for batch in batches:
            held.append(Sorted(batch, window))
            if sum(map(len, held)) >= CHUNK and held[0].head[0] != held[-1].head[-1]:
                rows = Sorted.joined(held)
                whole = rows.head != rows.head[-1]
                yield rows.part(np.flatnonzero(whole)).marks()
                held = [rows.part(np.flatnonzero(~whole))]
        if held:
            yield Sorted.joined(held).marks()

    def all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            yield from Sorted(batch, window).windows()

    def as_rows(columns: list[str], f):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in f(b for b in batches if len(b)):
                yield pa.RecordBatch.from_arrays([pa.array(part[c], pa.int64()) for c in columns], columns)

        return rows

    own = spread.mapInArrow(as_rows(list(MARK), sorted_marks), ", ".join(f"{c} long" for c in MARK))
    names = ["hash", "doc", "key", "low"]
    split = found.join(hot, "head", "left_semi").mapInArrow(as_rows(names, all_windows), ", ".join(f"{c} long" for c in names))
    split = stored(split.select("hash", F.struct("doc", "key", "low").alias("place")), "windows")
    often = small(stored(split.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "often"))
    split = split.join(often, "hash", "left_semi")
    first = split.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    first = small(stored(first.drop("last"), "first"))
    met = split.join(first, "hash").select("place.*", (F.col("place") > F.col("first")).alias("later"))
    met = met.withColumn("high", F.col("low") + window)
    met = met.select("key", "low", "high", "low", F.when(F.col("later"), F.col("high")).otherwise(F.col("low")))
    return own.union(met)


def _merged(low: np.ndarray, high: np.ndarray) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(zip(low.tolist(), high.tolist(), strict=True)):
        if a == b:
            continue
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"begin": a, "end": b})
    return out


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_repeated, n_removed, repeated and removed: spans of words, end exclusive. Repeated words lie
    in a match with any other place, removed ones in a match with an earlier one."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(_repeats(docs, window, gram), "repeats")


def _repeats(docs: DataFrame, window: int, gram: int) -> DataFrame:
    rows = keyed(docs)
    base = stored(heads(rows, window, gram), "heads")
    each = base.distinct().select("key", F.explode("heads").alias("head"))
    met = stored(each.groupBy("head").agg(F.count("*").alias("n")).where("n > 1"), "met")
    wanted = stored(each.join(met, "head", "left_semi").groupBy("key").agg(F.collect_set("head").alias("wanted")), "wanted")
    found = stored(suffixes(rows.join(wanted, "key"), window, gram), "suffixes")
    hot = met.where(F.col("n") > TASK_ROWS).select("head")
    spans = marks(found, hot, window).groupBy("key").agg(*(F.collect_list(c).alias(c) for c in ("low", "high", "later_low", "later_high")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            value = lambda c, k: batch.column(c)[k].values.to_numpy()
            merged = [[_merged(value(c, k), value(c + 1, k)) for k in range(len(batch))] for c in (1, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m, kind) for m in merged)], ["key", "repeated", "removed"])

    kind = "array<struct<begin: long, end: long>>"
    spans = stored(spans.mapInArrow(merge, f"key long, repeated {kind}, removed {kind}"), "spans")
    out = base.drop("heads").join(spans, "key", "left")
    none = F.array().cast(kind)
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    out = out.withColumns({c: F.coalesce(c, none) for c in ("repeated", "removed")})
    return out.select("doc_id", "n_words", size("repeated").alias("n_repeated"), size("removed").alias("n_removed"), "repeated", "removed")
