"""Corpus pipeline: stages over documents, each written and read again by its caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.llm.common import materialize, remainder, table

#: Least share of a text's letters in one language for the text to stay.
LEAST_SHARE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a certified cutoff go."""
    from maskspark.llm.quality import kept_rows

    return kept_rows(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised main language go. The model learns from rows outside the held-out ones, as the operator's own query does."""
    from maskspark.llm import language

    return language.recognised(docs, language.train(docs.where(remainder("doc_id", 4) != 2)), LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one row stays: of the smallest id, or of those without
    ids where there is none. Documents without words are in no component; they stay."""
    from maskspark.llm.ngram_join import linked

    key = ("doc_id", "text_hash")
    found = linked(docs, k=5, percent=75).where("root is not null").select("root", *key)
    same = materialize(found.groupBy("root", *key).agg(F.count(F.lit(1)).alias("rows")), "same")  # repeated rows are counted before they meet
    first = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), *key, "rows")).alias("x"))
    stay = materialize(first.select(*(F.col(f"x.{c}").alias(f"nd_{c}") for c in (*key, "rows"))), "stay")
    wordless = F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\f\r", "") == ""
    kept = docs.where(~wordless).join(stay, docs["doc_id"].eqNullSafe(stay["nd_doc_id"]) & (F.xxhash64("text") == stay["nd_text_hash"]))
    repeated = kept.where("nd_rows > 1").dropDuplicates(["nd_doc_id", "nd_text_hash"])
    return kept.where("nd_rows = 1").union(repeated).select(*docs.columns).union(docs.where(wordless))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is masked; n_chars follows the new text."""
    from maskspark.llm.pii import redact

    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from maskspark.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("n-gram jaccard join", near_duplicates),
    ("pii", personal_data),
    ("best-fit packing", packing),
]

#: The stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
