"""Named queries of these operators, each over its whole table."""

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm import best_fit_packing, decontamination, html_extraction, license_scans, ngram_join, pii, quality_rules, sharding, spelling, substring_dedup, token_files, url_filters, whitening
from patchlake.llm.shared import kept

#: Key of the surrogates in these queries. A real run takes its own from outside.
SURROGATE_KEY = "key of the sample queries"
SHARDS = 24
SEQUENCE = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    counts = url_filters.token_counts(pages, "url", url_filters.DEFAULT_RULES)
    return url_filters.judged(pages, "url", url_filters.DEFAULT_RULES, counts).select("page_id", "host", "path", "rule", "verdict")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extraction.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), "url", "html")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_packing.packed_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_file(), 0, SEQUENCE)
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scans.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return scanned.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_file(), 1)
    return token_files.read_token_files(spark, manifest).withColumnRenamed("key", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality_rules.fit(documents, _table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    judged = quality_rules.judged(documents, "text", trees)
    return judged.select("doc_id", *[f"quality.{c}" for c in quality_rules.COUNTS], "quality.base_failed", "quality.kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = kept(_table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    placed = sharding.sharded(rows, "doc_id", ["text_crc32", "size"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_table(spark, sf_dir, "documents"), "doc_id", "text", words=4, percent=85).withColumnRenamed("key", "doc_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", SURROGATE_KEY)
    return replaced.select("doc_id", "text", F.array_join("entities", " ").alias("kinds"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it holds."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.matched(documents, "text", _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("matches"))


def slips(doc_id: int | None) -> Callable[[str], str]:
    """Spelling slips of one document, a null id counting as an empty one: of each run of letters one letter goes where 31 divides its checksum."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def slip(word: str) -> str:
        h = zlib.crc32(word.encode(), start)
        at = h % len(word)
        return word if h % 31 else word[:at] + word[at + 1 :]

    return slip


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", least_length=7, least_count=2, change=slips)
    return spelling.variants(words, ratio=10)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whitened(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=8)
    return white.withColumnRenamed("key", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.deduplicated(_table(spark, sf_dir, "documents"), "doc_id", "text", window=20)
    return left.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_html_extraction, op3_best_fit_packing, op4_license_scans, op5_token_ids, op6_quality_rules, op7_sharding,
        op8_ngram_jaccard_join, op9_pii, op10_decontamination, op11_spelling_variants, op12_embedding_whitening, op13_substring_dedup, pipeline,
    )
}
