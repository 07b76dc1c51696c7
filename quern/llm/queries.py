"""The queries of this package, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import oracles
from quern.llm.licenses import scan_licenses
from quern.llm.media import media_features, store_media
from quern.llm.mixing import mix_sources
from quern.llm.neardup import near_duplicates
from quern.llm.pii import KINDS, find_personal_data, joined
from quern.llm.pieces import piece_digests
from quern.llm.quality import assess_quality
from quern.llm.reputation import judge_urls, url_host
from quern.llm.text import n_words, whole
from quern.llm.toxicity import score_toxicity
from quern.llm.warc import CaptureArchive, read_back
from quern.shared import Scratch
from quern.sources.tables import load


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_back(CaptureArchive.write(pages), pages)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = load(spark, sf_dir, "documents").select("doc_id", "source", n_words(whole("text")).alias("size"), F.md5(whole("text").cast("binary")).alias("digest"))
    sizes = Scratch(spark, "sizes").put(sizes)
    return mix_sources(sizes, size_col="size", digest_col="digest").select("doc_id", "size", "source_size", "target", "taken")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(load(spark, sf_dir, "documents"), piece_model())


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media_features(store_media(load(spark, sf_dir, "documents")))
    return read.withColumn("feature", F.lower(F.hex("feature"))).withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess_quality(load(spark, sf_dir, "documents"), carry=False).drop("outlier_distance")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(load(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select(F.col("_row.doc_id"), *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are the documents' of the same number: a page is bad where quality is 0 or toxic is 1."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    outcomes = pages.join(labels, "page_id").select(url_host(F.col("url")).alias("host"), "bad")
    return judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
