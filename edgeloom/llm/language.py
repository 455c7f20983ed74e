"""Language of a text as a mixture: expectation-maximisation over n-gram likelihoods, the set by penalised likelihood.

The model holds, for each language, smoothed frequencies of hashed 4-byte grams around letters. A text's proportions
maximise the likelihood of its grams under the mixture of languages; a further language enters only when it raises
the log-likelihood by more than a penalty that grows with the logarithm of the text's length.

Edge cases: a null text and one without a letter get `und`, score 0 and no languages; so does every text if no row is
labelled. The model takes 128 KB for each language on the driver and in each executor. Rows with null or repeated doc_id are predicted like others (a null doc_id is neither held out nor learned
from). Ties between languages go to the first by name. Whole texts count, however long. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .words import blocks

#: Buckets of the gram hash; labelled rows for each language that a model is fitted on, at most (chosen by hash).
BITS, MAX_ROWS = 15, 20_000
#: Each byte lies in four grams, so a text holds about a quarter as much evidence as its grams.
GRAM = 4
ROUNDS, SETTLED = 25, 1e-4

_CODES = np.arange(256, dtype=np.uint32)
_CODES[65:91] += 32
_CODES[:65] = _CODES[91:97] = _CODES[123:128] = 32


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _buckets(texts: pa.Array) -> Iterator[np.ndarray | None]:
    """The gram buckets of each row; None if it has no letter."""
    for _, _, data, offsets in blocks(texts):
        rows = len(offsets) - 1
        sizes = np.diff(offsets)
        codes = np.full(len(data) + GRAM * rows + GRAM, 32, np.uint32)
        codes[np.arange(len(data)) + np.repeat(np.arange(rows) * GRAM + 1, sizes)] = _CODES[data]
        letters = codes[1:] != 32
        n = len(codes) - GRAM + 1
        word = codes[:n]
        for j in range(1, GRAM):
            word = (word << np.uint32(8)) | codes[j : n + j]
        hashed = ((word * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)
        raw = data.tobytes()
        for k in range(rows):
            a = offsets[k] + GRAM * k
            b = a + sizes[k] + 1
            seg = hashed[a:b][letters[a:b]]
            ascii_letters = len(seg) and (codes[a + 1 : b] < 128)[letters[a : b - 1]].any()
            if ascii_letters or any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].decode("utf-8", "ignore")):
                yield seg
            else:
                yield None


def learn(docs: DataFrame, label: str = "lang", max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages by name and the gram frequencies of each (buckets by languages), from the labelled rows of `docs`
    that are not held out: all of a language's rows, or about `max_rows` of them by a hash where it has more."""
    small_batches(docs.sparkSession)
    known = F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    rows = docs.where(known & ~held_out()).select(F.col(label).alias("lang"), "text", F.xxhash64("doc_id").alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((1 << BITS, 0), np.float32)
    crowded = [k for k in names if sizes[k] > max_rows]
    if crowded:
        share = F.element_at(F.create_map(*(x for k in crowded for x in (F.lit(k), F.lit(int(max_rows / sizes[k] * (1 << 30)))))), F.col("lang"))
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < F.coalesce(share, F.lit(1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, grams in zip(batch.column(0).to_pylist(), _buckets(batch.column(1)), strict=True):
                if grams is not None:
                    sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    sums[lang] += np.bincount(grams, minlength=1 << BITS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    weights = np.empty((1 << BITS, len(names)), np.float32)
    weights[:] = 1.0 / (1 << BITS)  # of a language whose rows hold no gram
    for row in counted.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")).toLocalIterator():
        own = np.full(1 << BITS, 0.5)
        own[row["buckets"]] += row["n"]
        weights[:, names.index(row["lang"])] = own / own.sum()
    return names, weights


def _fit(p: np.ndarray, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """The mixture weights over the columns of p that make the gram counts c most likely, and their log-likelihood."""
    weights, n = start, c.sum()
    mixed = p @ weights
    for _ in range(ROUNDS):
        new = weights * (p.T @ (c / mixed)) / n
        done = np.abs(new - weights).max() < SETTLED
        weights, mixed = new, p @ new
        if done:
            break
    return weights, float(c @ np.log(mixed))


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how often each occurs. Never larger than the number of buckets, whatever the text."""
    if len(grams) >= 1 << BITS:
        counts = np.bincount(grams, minlength=1 << BITS)
        buckets = np.flatnonzero(counts)
        return buckets, counts[buckets].astype(np.float64)
    buckets, counts = np.unique(grams, return_counts=True)
    return buckets, counts.astype(np.float64)


def _fitted(grams: np.ndarray, frequencies: np.ndarray, share: np.ndarray) -> float:
    """The mean log-likelihood of a gram under the mixture, 0 for a text without one."""
    buckets, c = _counted(grams)
    return float(c @ np.log(frequencies[buckets] @ share) / c.sum()) if len(c) else 0.0


def proportions(grams: np.ndarray, frequencies: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """A text's share of each language (0 for those not selected)."""
    buckets, c = _counted(grams)
    p = frequencies[buckets].astype(np.float64)
    size = p.shape[1]
    out = np.zeros(size)
    if not len(c):
        out[0] = 1.0
        return out
    weights, top = _fit(p, c, np.full(size, 1 / size))
    order = np.argsort(-weights, kind="stable")
    fine = penalty * 0.5 * GRAM * math.log(max(2.0, c.sum()))
    best, chosen, value = -math.inf, order[:1], np.ones(1)
    for k in range(1, size + 1):
        take = order[:k]
        if k > 1 and (weights[take[-1]] < 1e-3 or top - fine * (k - 1) <= best):
            break
        own, like = (np.ones(1), float(c @ np.log(p[:, take[0]]))) if k == 1 else _fit(p[:, take], c, weights[take] / weights[take].sum())
        if like - fine * (k - 1) > best:
            best, chosen, value = like - fine * (k - 1), take, own
    out[chosen] = value / value.sum()
    return out


def _predict(texts: pa.Array, names: list[str], frequencies: np.ndarray, fitted: bool = False) -> Iterator[tuple[str, float, list[dict], float]]:
    """Language, score, languages, and how well the mixture fits (`_fitted`; only where asked for, else 0)."""
    for grams in _buckets(texts):
        if grams is None or not names:
            yield "und", 0.0, [], -math.inf if grams is None else 0.0
            continue
        share = proportions(grams, frequencies)
        top = int(share.argmax())
        fit = _fitted(grams, frequencies, share) if fitted else 0.0
        yield names[top], float(min(1.0, share[top])), [{"lang": names[i], "share": float(share[i])} for i in np.argsort(-share, kind="stable") if share[i] > 0], fit


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred (`und` without a letter), score (its share), languages (all that are in the text, with their
    shares, largest first). Reads nothing of a row but its text."""
    small_batches(docs.sparkSession)
    names, shared = model[0], docs.sparkSession.sparkContext.broadcast(model[1])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_predict(batch.column(1), names, shared.value))
            kinds = (pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "languages"])

    schema = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, schema)


#: Mean log-likelihood of a gram in a text that knows nothing of a language: all buckets are as likely.
UNKNOWN = -BITS * math.log(2)


def keep_identified(docs: DataFrame, min_share: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a letter, is explained better by its mixture of languages than by
    chance (UNKNOWN), and has a language that makes up `min_share` of it at least. Where no row is labelled, no text
    can be rejected for its language, and all with a letter stay."""
    small_batches(docs.sparkSession)
    names, frequencies = learn(docs)
    shared, text = docs.sparkSession.sparkContext.broadcast(frequencies), docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _predict(batch.column(text), names, shared.value, fitted=True)
            yield batch.filter(pa.array([fit > UNKNOWN and (score >= min_share or not names) for _, score, _, fit in found], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
