"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, filter_audit, html_extraction, language_id, license_scan, mixing, near_dedup, packing, quality_rules, spelling, substring_dedup, url_filter, warc
from .common import delete_folder, shared_dir, table

ORACLES: dict[str, str] = {}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1, F.lit(False))  # a null id has no remainder
    model = language_id.train(documents.where(~held_out).select("text", "lang"))
    found = language_id.identify(documents, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    """The vocabulary file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.realise(table(spark, sf_dir, "documents"))


ORACLES["op2_source_mixing"] = mixing.SQL


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 1024)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.measure(table(spark, sf_dir, "documents"), 200)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; a source is read as a tree with 64 consecutive ids in a directory."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 64).cast("string"), F.col("doc_id").cast("string"))
    return license_scan.scan(table(spark, sf_dir, "documents"), path)


#: Rules of the registered URL query: (verdict, host, path).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.fit(url_filter.labelled_urls())
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, weights).select("page_id", "host", "path", "rule", "verdict", "probability")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extraction.train(html_extraction.labelled_pages())
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"), model)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives go when they have been read."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    found = warc.round_trip(table(spark, sf_dir, "pages"), path)
    delete_folder(spark, path)
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLES["op11_warc_archives"] = warc.SQL


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = filter_audit.SQL


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling_variants"] = spelling.SQL


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_source_mixing, op3_best_fit_packing, op4_suffix_array_dedup, op5_license_scan, op6_url_filter, op7_minhash_near_dedup, op8_quality_rules, op9_html_extraction, op10_nearest_neighbours, op11_warc_archives, op12_filter_audit, op13_spelling_variants)}
