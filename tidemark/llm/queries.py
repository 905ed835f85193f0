"""The queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .common import materialize, table
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mixing import mix, words_in
from .near_dedup import near_dedup
from .packing import pack
from .pii import personal_data
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .topk import top_k
from .url_filter import RULES, judge_urls


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): every document without the lines of windows that come earlier. Nulls, empties, repeats: see line_dedup."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by words, at weights 1, 2, 3 of the sources; shards comma-joined. Null texts have size 0; else see mix."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "mixing-sizes")
    shards = F.array_join(F.transform("shards", lambda s: s.cast("string")), ",")
    return mix(sized).withColumn("shards", shards)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by RULES; null urls have the default. See judge_urls."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document; null texts have none. See license_scan."""
    return license_scan(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, base kinds and what contexts discover; null texts have none. See personal_data."""
    return personal_data(table(spark, sf_dir, "documents"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from labels that are not held out; a null doc_id is not held out. See quality_scores."""
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: ~held_out(doc_id))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and a verdict for every document; null texts fail. See quality_rules."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids; null texts are the end id. See pack."""
    return pack(table(spark, sf_dir, "documents"), tokenizer())


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by shingle sets; null texts are alone. See near_dedup."""
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other rows of every query vector; unusable vectors take no part. See top_k."""
    return top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_line_dedup, op2_mixing, op3_url_filters, op4_license_scans, op5_pii, op6_quality_classifier, op7_quality_rules, op8_packing,
            op9_minhash_near_dedup, op10_exact_top_k,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": oracle.line_dedup(),
        "op2_mixing": oracle.mixing(),
        "op3_url_filters": oracle.URL_RULES,
        "op4_license_scans": oracle.license_scan(),
        "op7_quality_rules": oracle.quality_rules(),
        "op9_minhash_near_dedup": oracle.near_dedup(),
        "op10_exact_top_k": oracle.TOP_K,
    }
