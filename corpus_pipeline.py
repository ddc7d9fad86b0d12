"""From raw documents to packed training sequences, in five stages; each is written and read again by the next."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm import best_fit_packing, decontamination, ngram_join, pii, quality_rules
from patchlake.llm.queries import SEQUENCE, SURROGATE_KEY, tokenizer_file
from patchlake.llm.shared import shared_folder


#: Words in a worker's cache of token ids: fewer than elsewhere, as workers here hold what is left of earlier stages too.
CACHED_WORDS = 300_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with the trees fitted on the labelled ones among them. Null and empty texts go, as all of
    under 20 words; rows are judged one by one, so repeated rows and null ids are no case of their own."""
    trees = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", "quality")
    out = _free(docs, "_quality")
    return quality_rules.judged(docs, "text", trees, out=out).where(f"{out}.kept").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8) the document of the smallest doc_id.

    doc_id tells documents apart: rows that have one doc_id and one text are one document, and come back as one.
    Rows without a doc_id can't be told apart and stay. Null and empty texts have no copies and stay."""
    groups = ngram_join.near_copies(docs, "doc_id", "text")
    stay = groups.where("key = component_id").select("key").distinct()
    print_of = _free(docs, "_text_hash")
    rows = docs.join(stay, docs["doc_id"] == stay["key"], "left_semi").withColumn(print_of, F.xxhash64("text"))
    return rows.dropDuplicates(["doc_id", print_of]).drop(print_of).unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = _free(docs, "_matches")
    return decontamination.matched(docs, "text", benchmark, out=out).where(F.size(out) == 0).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data in their texts, and n_chars of the new text. Null texts stay null."""
    out = _free(docs, "_entities")
    done = pii.pseudonymised(docs, "text", SURROGATE_KEY, out=out)
    chars = F.when(F.size(out) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequence and offset. Null and empty texts are one piece of the end id."""
    packed = best_fit_packing.packed_documents(docs, "doc_id", "text", tokenizer_file(), 0, SEQUENCE, cached_words=CACHED_WORDS)
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("best-fit packing", packed_sequences),
]

#: Fitted trees, token ids and edit distances are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage gives is written to the shared folder and read by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
