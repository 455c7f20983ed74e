"""WARC revisit records: a not-modified capture is resolved to the latest earlier full response of its canonical URL.

Input: record_id, url, time, status, headers (array of struct<name, value>), payload. A record with status 304 is a
revisit, one with status 200 a full response; others are left out. The as-of join compares (time, record_id).

The join is done in blocks of time: inside a block of a URL a window finds the latest response, and a window over the
blocks' last responses carries it on, so a URL that holds a large share of all records is dealt out over the blocks.
Payloads and headers join afterwards by record_id.

A validator is checked as RFC 9110 has it: entity tags by weak comparison where both sides have one, else equal
Last-Modified. Headers of the revisit replace those of the response, but for those that describe the stored payload or
the connection.

state: `resolved`, `mismatch` (validators differ), `unverifiable` (no validator on both sides), `missing` (no earlier
response). Edge cases: a null url, time or record_id is `missing`; header names are compared in lower case, and of a
repeated name the last value counts; null headers are none; of records with the same record_id and status the first by
(time, url, headers, payload) is kept, while records without a record_id are each one of their own. `time` may be a
number, a date or a timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .store import size, small, stored

#: Records in a block of time, about, and blocks at most; a URL with a share of all records has that share of each.
BLOCK_ROWS, BLOCKS = 250_000, 512
#: Headers that a not-modified answer must not change (RFC 9111, sections 3.1 and 3.2).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)


def canonical(url: Column) -> Column:
    """Without scheme, `www.`, default port, fragment, tracking parameters (utm_*, ref) and final slash; host in lower
    case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _value(headers: str, name: str) -> Column:
    return F.try_element_at(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), F.lit(-1))


def _header_map(headers: str) -> Column:
    named = F.filter(headers, lambda h: h["name"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda h: F.lower(h["name"])))
    last = lambda n: F.element_at(F.filter(named, lambda h: F.lower(h["name"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def _once(rows: DataFrame) -> DataFrame:
    """Of records with the same record_id and kind the first in a fixed order; all without a record_id. Only ids that occur
    more than once are compared, so that the payloads of all others are read where they are and not shuffled."""
    keys, order = ["record_id", "full"], ["time", "url", "headers", "payload"]
    counts = rows.where("record_id IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    twice = small(stored(counts.select(*keys), "twice"))
    first = rows.join(twice, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*order, "canonical_url")).alias("r"))
    return rows.join(twice, keys, "left_anti").select(*rows.columns).unionByName(first.select(*keys, "r.*"))


def resolve(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """record_id, url, canonical_url, time, state, source_id, headers (merged map) and payload of each revisit."""
    headers = F.coalesce("headers", F.array().cast("array<struct<name: string, value: string>>"))
    rows = records.where(F.col("status").isin(200, 304))
    rows = rows.select("record_id", "url", canonical(F.col("url")).alias("canonical_url"), "time", (F.col("status") == 200).alias("full"), headers.alias("headers"), "payload")
    rows = stored(_once(rows), "records")
    narrow = rows.where("canonical_url is not null and time is not null and record_id is not null")
    number = F.col("time").cast("double") if isinstance(records.schema["time"].dataType, NumericType) else F.col("time").cast("timestamp").cast("double")
    narrow = narrow.select("record_id", "canonical_url", "time", number.alias("at"), "full", _value("headers", "etag").alias("etag"), _value("headers", "last-modified").alias("modified"))
    blocks = blocks or max(1, min(BLOCKS, -(-size(rows) // BLOCK_ROWS)))
    cuts = narrow.stat.approxQuantile("at", [k / blocks for k in range(1, blocks)], 0.2 / blocks) if blocks > 1 else []
    block = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<double>"), lambda c: c <= F.col("at")))
    response = F.struct("time", "record_id", "etag", "modified")
    narrow = stored(narrow.withColumn("block", block).withColumn("response", F.when(F.col("full"), response)), "narrow")
    inside = Window.partitionBy("canonical_url", "block").orderBy("time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = narrow.where("full").groupBy("canonical_url", "block").agg(F.max("response").alias("response"))
    every = narrow.select("canonical_url", "block").distinct().join(lasts, ["canonical_url", "block"], "left")
    carried = every.select("canonical_url", "block", F.last("response", ignorenulls=True).over(before).alias("carried"))
    found = narrow.withColumn("found", F.last("response", ignorenulls=True).over(inside)).where(~F.col("full"))
    found = found.join(carried, ["canonical_url", "block"]).withColumn("found", F.coalesce("found", "carried"))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.when(F.col("etag").isNotNull() & F.col("found.etag").isNotNull(), tag("etag") == tag("found.etag")).otherwise(F.col("modified") == F.col("found.modified"))
    state = F.when(same, "resolved").when(~same, "mismatch").otherwise("unverifiable")
    found = found.select("record_id", F.col("found.record_id").alias("source_id"), F.when(F.col("found").isNotNull(), state).alias("state"))
    out = rows.where(~F.col("full")).join(found, "record_id", "left")
    sources = rows.where("full").select(F.col("record_id").alias("source_id"), F.col("headers").alias("stored"), F.col("payload").alias("body"))
    use = F.when(F.col("state") == "resolved", F.col("source_id"))
    out = out.drop("payload", "full").withColumn("source", use).join(sources.withColumnRenamed("source_id", "source"), "source", "left").drop("source")
    own = F.map_filter(_header_map("headers"), lambda k, v: ~k.isin(*NOT_MERGED))
    rest = F.map_filter(_header_map("stored"), lambda k, v: ~F.map_contains_key(own, k))
    merged = F.when(F.col("state") == "resolved", F.map_concat(rest, own)).otherwise(_header_map("headers"))
    state = F.coalesce("state", F.lit("missing")).alias("state")
    return out.select("record_id", "url", "canonical_url", "time", state, "source_id", merged.alias("headers"), F.col("body").alias("payload"))


def page_records(pages: DataFrame) -> DataFrame:
    """Records made from stored pages: each page is captured once in full and asked for again later, with a tag that
    fits but for every fifth page."""
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    digest, t = F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.col("page_id") * 10
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    full = F.array(header("ETag", tag), header("Content-Type", F.lit("text/html")), header("Content-Length", size), header("Date", t.cast("string")))
    later = t + 5 + F.pmod("page_id", F.lit(7)) * 10
    other = F.when(F.pmod("page_id", F.lit(5)) == 0, F.lit('"other"')).otherwise(tag)
    again = F.array(header("etag", F.concat(F.lit("W/"), other)), header("Content-Length", F.lit("0")), header("date", later.cast("string")), header("Cache-Control", F.lit("max-age=60")))
    first = pages.select((F.col("page_id") * 2).alias("record_id"), "url", t.alias("time"), F.lit(200).alias("status"), full.alias("headers"), F.col("html").alias("payload"))
    return first.union(pages.select(F.col("page_id") * 2 + 1, "url", later, F.lit(304), again, F.lit(None).cast("string")))
