"""Substring deduplication: word windows that an earlier document holds too, found by recompression.

A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+` of one document. A word goes when it lies in a window
whose words also occur, in that order, in a document with a smaller doc_id. Windows are judged on the input.

Spark rounds name ever longer symbols, and what two documents share of one round goes on to the next. In the first one
the runs and pairs of the recompressed texts are named (recompression.py): every window has an anchor, the longest of
its symbols. In the second one the runs of half a window are, inside the windows whose anchor is shared: every window
has a core, the run of smallest hash. In the third one the windows themselves are, where their core is shared, and those
that two documents hold are the repeats. Equal windows have equal anchors, cores and names, so none is lost; a name
is a hash of 64 bits of what it stands for, the same in every task.

Edge cases: a null, empty or blank text, and one of fewer words than a window, loses nothing; of equal texts the one
with the smallest doc_id stays whole; rows with the same doc_id do not judge each other; a row with a null doc_id
neither loses words nor makes others lose any; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recompression import anchored, least_runs, window_starts
from .store import scratch, small_batches, stored
from .text_columns import keyed
from .words import SPACED, blocks, grams, hashed_words

WINDOW = 13
#: Passes in which the windows are compared, by their name: so much less lies in shuffle files at a time.
PASSES = 2


def _ints(x: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, kind)


def _among(own: np.ndarray, at: np.ndarray, first: np.ndarray, names: pa.Array) -> np.ndarray:
    """Of windows that begin at the words `at` and are called `own`: whether the list of their row holds that name."""
    wanted, ends = names.flatten().to_numpy().view(np.uint64), names.offsets.to_numpy() - names.offsets[0].as_py()
    cut = np.searchsorted(at, first)
    take = np.zeros(len(at), bool)
    for k in range(len(first) - 1):
        take[cut[k] : cut[k + 1]] = np.isin(own[cut[k] : cut[k + 1]], wanted[ends[k] : ends[k + 1]])
    return take


def _new_names(ids: np.ndarray, at: np.ndarray, first: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """(doc_id, name): the different names of each row."""
    row = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((names, row))
    row, names = row[order], names[order]
    new = np.append(True, (row[1:] != row[:-1]) | (names[1:] != names[:-1])) if len(row) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([_ints(ids[row[new]]), _ints(names[new])], ["doc_id", "name"])


def anchors(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, name): the different anchors of each text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in blocks(batch.column(1)):
                words, first, begin, end = hashed_words(data, offsets, SPACED)
                at, names, _ = anchored(words, first, end - begin, window)
                yield _new_names(ids[a:b], at, first, names)

    return rows.select("doc_id", "text").mapInArrow(parse, "doc_id long, name long")


def cores(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, name): the different cores of the windows of `rows` (doc_id, text, names) whose anchor is one of `names`."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in blocks(batch.column(1)):
                words, first, begin, end = hashed_words(data, offsets, SPACED)
                at, own, _ = anchored(words, first, end - begin, window)
                at = at[_among(own, at, first, batch.column(2).slice(a, b - a))]
                yield _new_names(ids[a:b], at, first, least_runs(words, window)[at])

    return rows.select("doc_id", "text", "names").mapInArrow(parse, "doc_id long, name long")


def windows(rows: DataFrame, window: int) -> DataFrame:
    """(name, doc_id, key, at) of the windows of `rows` (doc_id, key, text, names) whose core is one of `names`."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b, data, offsets in blocks(batch.column(2)):
                words, first, _, _ = hashed_words(data, offsets, SPACED)
                at = window_starts(first, window)
                at = at[_among(least_runs(words, window)[at], at, first, batch.column(3).slice(a, b - a))]
                row = np.searchsorted(first, at, "right") - 1
                columns = [_ints(grams(words, window)[at]), _ints(ids[a:b][row]), _ints(keys[a:b][row]), _ints(at - first[row], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["name", "doc_id", "key", "at"])

    return rows.select("doc_id", "key", "text", "names").mapInArrow(parse, "name long, doc_id long, key long, at int")


def shared_names(named: DataFrame) -> DataFrame:
    """(doc_id, names): the names of each document that another document has too, from (doc_id, name). The names that are
    met grow with the input, so they are never broadcast: shuffle files are in proportion to it at every size."""
    with scratch(named.sparkSession) as keep:
        named = stored(named, "named")
        met = named.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name")
        met = stored(met, "met")
        return keep(named.join(met.hint("merge"), "name", "left_semi").groupBy("doc_id").agg(F.collect_set("name").alias("names")), "shared")


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, starts): the words at which a window begins that a document with a smaller doc_id holds too."""
    known = rows.where("doc_id is not null")
    with scratch(rows.sparkSession) as keep:
        shared = shared_names(anchors(known, window))
        shared = shared_names(cores(known.join(shared, "doc_id"), window))
        found = stored(windows(known.join(shared, "doc_id"), window), "windows")
        parts = []
        for k in range(PASSES):
            part = found.where(F.pmod("name", F.lit(PASSES)) == k)
            least = part.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name", "low")
            least = stored(least, "least")
            gone = part.join(least.hint("merge"), "name").where("doc_id > low")
            parts.append(stored(gone.groupBy("key").agg(F.collect_set("at").alias("starts")), "starts"))
        return keep(reduce(DataFrame.union, parts).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts")), "starts")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words that stay, one space between), removed (spans of words, end
    exclusive)."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    marked = rows.join(repeated_windows(rows, window), "key", "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts, spans = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.encode().split()
                steps = np.zeros(len(words) + 1, np.int64)
                if starts.is_valid:
                    first = starts.values.to_numpy()
                    np.add.at(steps, first, 1)
                    np.add.at(steps, first + window, -1)
                gone = np.cumsum(steps[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                spans.append([{"begin": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                kept, at = [], 0
                for s in spans[-1]:
                    kept += words[at : s["begin"]]
                    at = s["end"]
                kept += words[at:]
                sizes.append((len(words), int(gone.sum())))
                texts.append(b" ".join(kept).decode())
            kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array([s[i] for s in sizes], pa.int64()) for i in (0, 1)]
            names = ["doc_id", "n_words", "n_removed", "text", "removed"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(texts, pa.string()), pa.array(spans, kinds)], names)

    schema = "doc_id long, n_words long, n_removed long, text string, removed array<struct<begin: long, end: long>>"
    return marked.mapInArrow(cut, schema)
