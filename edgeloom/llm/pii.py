"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers that they miss.

The fixed patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Their matches are seeds, and so
are hexadecimal strings of 32 to 64 digits that are assigned to a name like key or token: seeds of the kind `secret`. What
a word like commit or digest names is a checksum, which is neither a seed nor reported. Every token that looks like an identifier, a seed or not, has contexts: lexical
patterns of the words and signs next to it, of several lengths and with a gap, within REACH code points, and the label
that begins its line. Contexts and identifier values form a bipartite graph on which Spark passes scores back and forth:
a context's confidence for a kind is the share of its different values that are of that kind, discounted where it has
met few; a value is of a kind if one of its contexts is confident of it. Such values count as seeds in the next round.
At the end, what is no match of a fixed pattern but has the form of a kind, and stands in a context of high confidence
for it, is added. A secret needs a word and a sign of assignment in its context.

A context in which many values are of no known kind can never be that sure. It counts as leading to a kind if it has a word,
twice the support, two fifths known values, and next to none that could not be of the kind; two such contexts around
a value that has the form are as good as a sure one.

Edge cases: a null or empty text has no spans; without seeds nothing is added; a value or context that repeats counts
once for each different partner; rows that agree in doc_id and text are alike; a null doc_id is kept; the patterns take
time in proportion to a text's length, however long its runs of letters or digits are. Positions are code points, ends
exclusive. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import scratch, small, small_batches, stored
from .text_columns import keyed

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: Rounds of scores; different values that a context must have met; confidence at which a context or value counts.
ROUNDS, SUPPORT, CONFIDENT = 3, 5, 0.8
#: Code points looked at on either side of an identifier for its context, and for the label at the start of its line.
REACH = 48

#: The part of an e-mail address from its @ on, and what may stand before it.
DOMAIN, LOCAL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins at the first digit of a run: if it fails there, it fails at each later digit too.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: a disguised @ with what follows, a run of digits and signs, a long run of letters and digits.
DISGUISED = re.compile(r"(?:@|\(at\)|\[at\])[A-Za-z0-9.-]*[A-Za-z0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[0-9().:]|[\x20-](?=[0-9(]))*[0-9]")
OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+")
HEX = re.compile(r"[0-9A-Fa-f]{32,64}")
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]")
LABEL = re.compile(r"\s*([^\W\d_]+)\s*[:=]")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
ASSIGNED = ("=", ":")
#: Words before a secret, and before a checksum, which looks the same; so many words and signs before are looked at.
KEY_WORDS = frozenset(("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "credential", "credentials", "bearer"))
CHECKSUM_WORDS = frozenset(("commit", "sha", "md", "etag", "integrity", "digest", "checksum", "hash", "rev", "revision", "crc", "blob", "tree"))
NAMED = 6
#: A context that leads to a kind: known values of all, and values of all that could not be of the kind, at most.
LEADING, STRANGE = 0.4, 0.05


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _with_local(text: str, ends: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of the matches of `ends` with the LOCAL characters before, of which there must be one. Each character is
    looked at once, so a long run of letters costs its length."""
    done = 0
    for m in ends.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches of the fixed patterns, by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in _with_local(text, DOMAIN)]
    if DIGIT.search(text):
        small = lambda p: len(p) <= 3 and int(p or 0) <= 255
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(small(p.lstrip("0")) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def forms(value: str) -> list[str]:
    """The kinds that a number-like string could be of by its digits and form."""
    n = len(DIGIT.findall(value))
    parts = re.split(r"[.:]", value)
    if len(parts) >= 4 and all(p.isdigit() for p in parts):
        return ["ip"]
    return (["card"] if 13 <= n <= 19 else []) + (["phone"] if 7 <= n <= 15 else [])


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns that a span stands in."""
    near = text[max(0, start - REACH) : start].lower()
    before, after = TOKEN.findall(near)[-3:], TOKEN.findall(text[end : end + REACH].lower())[:1]
    out = [" ".join(before[-k:]) + " _" for k in range(1, len(before) + 1)]
    out += [" ".join(before[-k:]) + f" _ {after[0]}" for k in range(1, min(2, len(before)) + 1) if after]
    if len(before) == 3:
        out.append(f"{before[0]} * {before[2]} _")
    line = text.rfind("\n", max(0, start - REACH), start) + 1
    if (line or start <= REACH) and (label := LABEL.match(text, line, start)):
        out.append(f"{label[1].lower()} : ... _")
    return out


def _words_before(text: str, start: int) -> list[str]:
    return TOKEN.findall(text[max(0, start - REACH) : start].lower())[-NAMED:]


def _likely(text: str) -> Iterator[tuple[int, int, list[str], str | None]]:
    """(start, end, forms, the kind if it is a seed by its form) of what looks like an identifier."""
    if "@" in text or "(at)" in text or "[at]" in text:
        yield from ((*span, ["email"], None) for span in _with_local(text, DISGUISED))
    for m in NUMBER.finditer(text):
        inside = text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum()  # a part of a longer name
        if not inside and (could := forms(m[0])):
            yield *m.span(), could, None
    for m in OPAQUE.finditer(text):
        if len(DIGIT.findall(m[0])) >= 4 and LETTER.search(m[0]):
            before = _words_before(text, m.start())
            if CHECKSUM_WORDS.isdisjoint(before):
                named = not KEY_WORDS.isdisjoint(before) and any(x in ASSIGNED for x in before)
                yield *m.span(), [SECRET], SECRET if named and HEX.fullmatch(m[0]) else None


def _scan(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and the identifier-like ones with value, kind (that of an overlapping base span, or of its form),
    whether it is a base span, forms, contexts."""
    base, likely = base_spans(text), []
    if "@" in text or "at" in text or DIGIT.search(text):
        at = 0
        places = sorted(base, key=lambda x: x[1])
        furthest = [0] * (len(places) + 1)
        for k, (_, _, b) in enumerate(places):
            furthest[k + 1] = max(furthest[k], b)
        for start, end, could, kind in sorted(_likely(text), key=lambda x: x[:2]):
            while at < len(places) and furthest[at + 1] <= start:
                at += 1
            own = places[at][0] if at < len(places) and places[at][1] < end else None
            likely.append({"start": start, "end": end, "value": text[start:end].lower(), "kind": own or kind, "base": own is not None, "forms": could, "contexts": contexts(text, start, end)})
    return [{"kind": k, "start": a, "end": b} for k, a, b in base], likely


SPAN = "struct<kind: string, start: long, end: long>"
LIKE = "struct<start: long, end: long, value: string, kind: string, base: boolean, forms: array<string>, contexts: array<string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_LIKE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("kind", pa.string()), ("base", pa.bool_()), ("forms", pa.list_(pa.string())), ("contexts", pa.list_(pa.string()))])


def scanned(rows: DataFrame) -> DataFrame:
    """doc_id, key, base (spans) and likely (identifier-like tokens) of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_scan(t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(_SPAN)), pa.array([f[1] for f in found], pa.list_(_LIKE))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "base", "likely"])

    return rows.select("doc_id", "key", "text").mapInArrow(scan, f"doc_id long, key long, base array<{SPAN}>, likely array<{LIKE}>")


def _bootstrapped(likely: DataFrame, rounds: int, support: int, confident: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(context, kind) of high confidence, (value, kind) of what is known in the end, and the edges (context, value, n)."""
    edges = stored(likely.select(F.explode("contexts").alias("context"), "value").distinct(), "edges")
    sizes = stored(edges.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= support), "sizes")
    edges = stored(edges.join(small(sizes), "context"), "edges")
    seeds = stored(likely.where("kind is not null").select("value", "kind").distinct(), "seeds")
    assigned = F.exists(F.split("context", " "), lambda t: t.isin(*ASSIGNED)) & F.col("context").rlike(WORDED)
    known, best = seeds, None
    for _ in range(rounds):
        met = edges.join(small(known), "value").groupBy("context", "kind").agg(F.count("*").alias("hits"), F.first("n").alias("n"))
        sure = (F.col("hits") >= support) & (F.col("hits") / (F.col("n") + 1) >= confident) & ((F.col("kind") != SECRET) | assigned)
        best = stored(met.where(sure).select("context", "kind"), "best")
        new = likely.where("kind is null").select("value", F.explode("contexts").alias("context"), "forms").join(small(best), "context")
        new = new.where(F.expr("array_contains(forms, kind)")).select("value", "kind")
        known = stored(seeds.union(new).distinct(), "known")
    return best, known, edges


def confident_contexts(likely: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(context, kind) of high confidence, from identifier-like tokens (value, kind, forms, contexts).

    Each round joins the edges between contexts and values with the values' kinds and counts by context with partial
    sums; neither a frequent context nor a frequent value is gathered anywhere."""
    return _bootstrapped(likely, rounds, support, confident)[0]


#: A context with a word beside the place of the value.
WORDED = r"\p{L}"


def leading_contexts(likely: DataFrame, known: DataFrame, edges: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(context, kind) of contexts with many values of no known kind that nevertheless lead to a kind."""
    met = edges.join(small(known), "value").groupBy("context", "kind").agg(F.count("*").alias("hits"), F.first("n").alias("n"))
    enough = (F.col("hits") >= 2 * support) & (F.col("hits") / (F.col("n") + 1) >= LEADING) & F.col("context").rlike(WORDED) & (F.col("kind") != SECRET)
    candidates = stored(met.where(enough).select("context", "kind", "n"), "candidates")
    shapes = likely.select("value", "forms").distinct()
    strange = edges.select("context", "value").join(small(candidates), "context").join(shapes, "value").join(known.withColumn("known", F.lit(True)), ["value", "kind"], "left")
    strange = strange.where(F.expr("known IS NULL AND NOT array_contains(forms, kind)")).groupBy("context", "kind").agg(F.count("*").alias("strange"))
    out = candidates.join(strange, ["context", "kind"], "left").where(F.coalesce("strange", F.lit(0)) <= STRANGE * F.col("n"))
    return stored(out.select("context", "kind"), "leading")


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, base and spans: (kind, start, end), by kind in the order of KINDS, SECRET last, then start. `spans` has
    the base ones and those that the bootstrapping adds; an added one overlaps none of its kind."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        rows = keep(scanned(keyed(docs)), "scanned")
        likely = rows.select("key", F.explode("likely").alias("x")).select("key", "x.*")
        best, known, edges = _bootstrapped(likely, rounds, support, confident)
        leading = leading_contexts(likely, known, edges, support)
        votes = stored(best.withColumn("vote", F.lit(2)).union(leading.join(best, ["context", "kind"], "left_anti").withColumn("vote", F.lit(1))), "votes")
        added = likely.where("NOT base").select("key", "start", "end", "forms", F.explode(F.array_distinct("contexts")).alias("context")).join(small(votes), "context")
        added = added.where(F.expr("array_contains(forms, kind)")).groupBy("key", "start", "end", "kind").agg(F.max("vote").alias("best"), F.count_distinct("context").alias("n"))
        added = added.where("best = 2 OR n >= 2").select("key", F.struct("kind", "start", "end").alias("x"))
        added = keep(added.groupBy("key").agg(F.collect_list("x").alias("added")), "added")
    out = rows.select("doc_id", "key", "base").join(small(added), "key", "left")
    free = F.filter(F.coalesce("added", F.array().cast(f"array<{SPAN}>")), lambda x: ~F.exists("base", lambda y: (x["kind"] == y["kind"]) & (x["start"] < y["end"]) & (y["start"] < x["end"])))
    place = F.create_map(*(F.lit(v) for k, kind in enumerate((*KINDS, SECRET)) for v in (kind, k)))
    in_order = F.sort_array(F.transform(F.concat("base", free), lambda x: F.struct(place[x["kind"]].alias("place"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return out.select("doc_id", "base", F.transform(in_order, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
