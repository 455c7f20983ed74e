"""Compression of vectors to one byte a part: product codebooks by delta-maintained Lloyd rounds, in integers.

A component x becomes floor(SCALE * x). A vector is cut into `parts` equal parts, and each part position has a codebook
of up to `entries` entries, which starts as that part of the first rows by vec_id. A round assigns every part to its
nearest entry (squared distance, ties to the lower index) and moves each entry to the floor of its parts' mean; an entry
without parts stays.

What a round leaves is stored: each row with its assignments, and for each entry the number of its parts and their
integer sum. The next round writes the rows with their new assignments, in place, without a shuffle; a part whose
assignment changed is taken from its old entry and added to its new one, each task adds these contributions up, and only
they are shuffled. Integer sums give the same result in any order. Codebooks and sums are bounded (parts * entries
entries of a part's components), whatever the number of rows; they alone pass through the driver.

Edge cases: rows whose vector is null or holds a null or non-finite component are dropped; rows that repeat, in vec_id
or in all columns, are rows of their own, each with its code, and first rows are taken by vec_id, then vector; a null
vec_id is kept and comes last in that order; fewer rows than entries give fewer entries; null labels are one label; an
empty table, or one of dropped rows, gives an empty result. An error is raised where lengths differ, where a length is no
multiple of `parts`, or where squared distances could pass 63 bits. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import scratch, size, small, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a label, where labels are too many to broadcast, are dealt out to so many tasks.
SALTS = 32
#: Distances of so many rows are held at a time.
CHUNK = 4096


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label and q, the integer components, of the rows that are kept."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    return rows.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v * SCALE)).cast("array<long>").alias("q"))


def _nearest(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of vectors, each part's nearest entry, and its squared distance. `books` is parts x entries x width."""
    parts, entries, width = books.shape
    codes, least = np.empty((len(q), parts), np.int64), np.empty((len(q), parts), np.int64)
    bound = max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0))), int(np.abs(books).max(initial=0)))
    exact = 4 * width * bound * bound < 1 << 53  # then products of floating-point matrices are exact
    for k in range(parts):
        own, book = q[:, k * width : (k + 1) * width], books[k]
        for at in range(0, len(q), CHUNK):
            x = own[at : at + CHUNK]
            if exact:
                xf, bf = x.astype(np.float64), book.astype(np.float64)
                far = (bf * bf).sum(1) - 2 * (xf @ bf.T) + (xf * xf).sum(1)[:, None]
            else:
                far = np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)
            codes[at : at + CHUNK, k] = far.argmin(1)  # the first of several
            least[at : at + CHUNK, k] = far.min(1)
    return codes, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows (vec_id, label, q, code) with their assignments by `books` as code, the former ones as old, and the
    squared distances summed over parts as error."""
    width = books.shape[0] * books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, far = _nearest(_matrix(batch.column(2), width), books)
            columns = [*batch.columns[:3], batch.column(3), pa.array(list(codes.astype(np.int16)), pa.list_(pa.int16())), pa.array(far.sum(1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "q", "old", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id long, label {label}, q array<long>, old array<short>, code array<short>, error long")


def contributions(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, place, value): what the parts of `rows` whose assignment changed add to the running sums, added up
    in each task. Place -1 is the number of parts, the others are components."""
    parts, entries, width = shape

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column(0), parts * width)
            new = _matrix(batch.column(2), parts).astype(np.int64)
            before = batch.column(1)
            old = _matrix(before.fill_null([-1] * parts) if before.null_count else before, parts).astype(np.int64)
            for k in range(parts):
                own = np.concatenate([np.ones((len(q), 1), np.int64), q[:, k * width : (k + 1) * width]], 1)
                changed = new[:, k] != old[:, k]
                np.add.at(sums, k * entries + new[changed, k], own[changed])
                gone = changed & (old[:, k] >= 0)
                np.subtract.at(sums, k * entries + old[gone, k], own[gone])
        at, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at // entries), pa.array(at % entries), pa.array(place - 1), pa.array(sums[at, place])], ["part", "entry", "place", "value"])

    changed = rows.where("old IS NULL OR old <> code").select("q", "old", "code")
    return changed.mapInArrow(moved, "part long, entry long, place long, value long")


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width: the parts of the first rows by vec_id."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    q = np.array([r["q"] for r in first], np.int64)
    return q.reshape(len(q), parts, -1).transpose(1, 0, 2)


def _moved_books(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for part, entry, place, value in sums.collect():  # at most one row for each component of the codebooks
        total[part, entry, place + 1] = value
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)


def _checked(rows: DataFrame, parts: int) -> int:
    """The width of a part; an error where vectors cannot be cut into equal ones or numbers would be too large."""
    low, high, most = rows.agg(F.min(F.size("q")), F.max(F.size("q")), F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q"))))).first()
    if low != high or low % parts or low == 0:
        raise ValueError(f"vectors have {low} to {high} components; all must have the same number, a multiple of {parts}")
    if low * (2 * most) ** 2 >= 1 << 63:
        raise ValueError(f"components of up to {most} make squared distances beyond 63 bits")
    return low // parts


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of each row that is kept, code as an array of entry indexes, and the codebooks
    (parts x entries x width; None without rows)."""
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        source = stored(quantised(vectors).withColumn("code", F.lit(None).cast("array<short>")), "quantised")
        if not size(source):
            label = source.schema["label"].dataType.simpleString()
            return spark.createDataFrame([], f"vec_id long, label {label}, code array<short>, error long"), None
        _checked(source, parts)
        books = first_books(source, parts, entries)
        sums = None
        rows = source
        for _ in range(rounds):
            with scratch(spark) as keep_round:
                rows = keep_round(assigned(rows, books), "rows")
                delta = contributions(rows, books.shape)
                delta = delta if sums is None else sums.union(delta)
                sums = keep_round(delta.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).where("value <> 0"), "sums")
            books = _moved_books(books, sums)
            rows = rows.select("vec_id", "label", "q", "code")
        return keep(assigned(rows, books).select("vec_id", "label", "code", "error"), "codes"), books


def by_label(codes: DataFrame) -> DataFrame:
    """`codes` with label_error, the error summed over the rows of equal label. A frequent label is one row of the table
    that is joined: broadcast if that is small, else repeated for SALTS tasks."""
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    held = small(sums)
    if held is sums:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        sums, codes = sums.select("label", "label_error", salts), codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        met = codes["label"].eqNullSafe(sums["label"]) & (codes["salt"] == sums["salt"])
    else:
        sums = held
        met = codes["label"].eqNullSafe(sums["label"])
    return codes.join(sums, met).select(*(codes[c] for c in codes.columns if c != "salt"), sums["label_error"])


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components, decimal, by part, entry, place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()
