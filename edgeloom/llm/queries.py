"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, language, licenses, line_dedup, near_dedup, oracles, packing, pii, quality, substrings, suffixes, vector_codes, warc
from .store import table


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["begin"], x["end"])), ",")
    return found.select("doc_id", "n_words", "n_repeated", "n_removed", spans.alias("removed"))


def op3_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.page_records(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda h: F.concat(h["key"], F.lit(": "), h["value"])))
    lines, digest = F.array_join(entries, "\n"), F.sha2(F.col("payload").cast("binary"), 256)
    return found.select("record_id", "url", "canonical_url", "time", "state", "source_id", lines.alias("headers"), digest.alias("payload_sha256"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "languages")


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = (count(kind).alias(f"n_{kind}") for kind in pii.KINDS)
    digest = F.sha2(text("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))), "")
    return vector_codes.by_label(codes).select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.found(table(spark, sf_dir, "documents"))
    labels = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat(*spans), lambda x: x["label"]))), ",")
    starts = F.transform("base", lambda x: x["start"])
    matches = F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"])), ",")
    places = F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word")
    return found.select("doc_id", "n_words", *places, labels("base").alias("base_labels"), labels("base", "matches").alias("labels"), "score", matches.alias("matches"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_fuzzy_lines,
        op2_suffix_array,
        op3_likelihood_ratio,
        op4_revisits,
        op5_lsh_forest,
        op6_language_mixture,
        op7_harmonic_packing,
        op8_contextual_pii,
        op9_winnowing,
        op10_recompression,
        op11_delta_lloyd,
        op12_license_templates,
        op13_collocations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
