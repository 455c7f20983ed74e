"""Harmonic packing of token sequences: pieces in reciprocal-capacity classes, each class's bins with a fixed count.

A document's tokens are cut into pieces of a length that some whole number j of them nearly fills `capacity`; j is the
piece's class, and a bin of class j takes exactly j pieces, so no bin of a class depends on another's. Each task fills
bins of its own; what a class has left over in the tasks (fewer than j pieces each) fills further bins by rank, and
what then remains (fewer than j pieces a class, fewer than `capacity` tokens a class, whatever the input) is packed
best-fit, longest first.

Edge cases: a null or empty text is the end token alone; repeated rows are packed as often as they occur; a null
doc_id is kept; an empty table gives no piece. Other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import id_text, small_batches, stored
from .words import KEPT

CAPACITY, END, TOKENIZER = 4096, 2, "word_bpe_49k.json"
#: Tokens that a full bin may lack.
SLACK = 24
#: The number under which pieces from several tasks share bins; tasks have smaller ones.
SHARED_TASK = (1 << 20) - 1
#: Encoded runs of characters that a worker remembers: about 200 bytes each, in a table that need not be doubled for them.
REMEMBERED = 600_000


def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of n tokens."""
    out = [(k, capacity, 1) for k in range(0, n - capacity + 1, capacity)]
    at = len(out) * capacity
    while at < n:
        rest = n - at
        j = capacity // rest
        if capacity - j * rest > slack and rest * rest > capacity:
            j += 1
            rest = capacity // j
        out.append((at, rest, j))
        at += rest
    return out


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes. The vocabulary's own rule splits a text into runs of letters,
    digits and other characters before it merges, so runs are encoded apart, each once while it is remembered. A text
    with characters whose class or lower case is not plain is encoded whole."""

    #: The vocabulary's rule, for the characters of `plain` texts.
    runs = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
    unusual = re.compile(r"[^\x00-\x1b\x20-\x7fß-öø-ÿ¡¿«»€–—‘’“”…]|<\|")

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.splits = name == TOKENIZER  # the runs are its own; texts are encoded whole by any other one
        self.known: dict[str, bytes] = {}

    def learn(self, runs: list[str]) -> None:
        for k in range(0, len(runs), 20_000):
            part = runs[k : k + 20_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, cut = np.array(found.ids, "<u4").tobytes(), 4 * np.searchsorted(found.word_ids, np.arange(len(part) + 1))
            self.known.update((w, ids[a:b]) for w, a, b in zip(part, cut[:-1].tolist(), cut[1:].tolist(), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        lower = [t.lower() for t in texts]
        split = [None if self.unusual.search(t) else self.runs.findall(t) for t in lower]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(list(set().union(*(s for s in split if s)) - self.known.keys()))
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(t) if s is None else b"".join(map(self.known.__getitem__, s)) for t, s in zip(texts, split, strict=True)]


def encoder(name: str) -> Encoder:
    """The encoder that this Python process keeps from task to task, with what it remembers, until an operator that cuts
    texts into blocks has its turn (words.forget)."""
    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT))
    if not hasattr(kept, name):
        setattr(kept, name, Encoder(name))
    return getattr(kept, name)


def pieces(docs: DataFrame, name: str, capacity: int, ids: bool) -> DataFrame:
    """The cut pieces, with the task that cut them and their number in its class there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(name), Counter(), pyspark.TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, len(batch), 250):
                rows = []
                part = batch.slice(k, 250)
                for doc, text in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    text += END.to_bytes(4, "little")
                    for start, length, j in cuts(len(text) // 4, capacity):
                        own = text[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(own), len(text) // 4, task, j, seen[j], own if ids else None))
                        seen[j] += 1
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds, strict=True)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "class", "number", "ids"]
    types = ["long"] * 5 + ["int", "int", "long", "binary"]
    return id_text(docs).mapInArrow(cut, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def best_fit(rest: pd.DataFrame, capacity: int) -> pd.Series:
    """Bin numbers for a bounded number of pieces, longest first into the fullest bin that has room."""
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    out = {}
    for i, length in rest["length"].sort_values(ascending=False, kind="stable").items():
        fit = next((r for r in range(length, capacity) if by_room.get(r)), None)
        if fit is None:
            k = len(room)
            room.append(capacity)
        else:
            k = by_room[fit].pop()
        room[k] -= length
        by_room.setdefault(room[k], []).append(k)
        out[i] = k
    return pd.Series(out, dtype="int64").reindex(rest.index)


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with `ids`, also the
    token ids as little-endian unsigned 32-bit bytes."""
    small_batches(docs.sparkSession)
    all_ = stored(pieces(docs, tokenizer, capacity, ids), "pieces")
    sizes = all_.groupBy("class", "task").agg(F.count("*").alias("n")).withColumn("full", F.col("n") - F.col("n") % F.col("class"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("n") - F.col("full")
    sizes = sizes.withColumn("before", F.coalesce(F.sum(left).over(before), F.lit(0))).withColumn("left", F.sum(left).over(Window.partitionBy("class")))
    placed = all_.join(sizes.drop("n"), ["class", "task"])
    rank = F.col("before") + F.col("number") - F.col("full")
    bin_id = lambda task, n: (task.cast("long") * 8192 + F.col("class")) * (1 << 30) + F.floor(n / F.col("class")).cast("long")
    own, met = F.col("number") < F.col("full"), rank < F.col("left") - F.col("left") % F.col("class")
    if (all_.agg(F.max("task").alias("last")).first()["last"] or 0) >= SHARED_TASK:
        raise ValueError(f"at most {SHARED_TASK} input partitions can be packed at once")
    shared_task = F.lit(SHARED_TASK)
    placed = placed.withColumn("sequence_id", F.when(own, bin_id(F.col("task"), F.col("number"))).when(met, bin_id(shared_task, rank)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])]
    placed = stored(placed.select(*columns, "task", "number", "class", "sequence_id"), "placed")

    def settle(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["class", "task", "number"], ignore_index=True)
        rest["sequence_id"] = best_fit(rest, capacity) + SHARED_TASK * 8192 * (1 << 30)
        return rest

    rest = placed.where("sequence_id is null").groupBy(F.lit(0).cast("long").alias("all")).applyInPandas(settle, placed.schema)
    in_order = Window.partitionBy("sequence_id").orderBy("task", "number", "class").rowsBetween(Window.unboundedPreceding, -1)
    done = placed.where("sequence_id is not null").union(rest)
    return done.withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0))).drop("task", "number", "class")
