"""A training-corpus pipeline: quality rules, line dedup, near-duplicate join, benchmark decontamination, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; ``run`` writes each stage's result as Parquet to the shared folder and gives it to the
next one. Edge cases are those of the operators: documents with null or blank text fail the quality rules, and
near-duplicates and benchmark passages are found by row, so rows with null or repeated ids are treated like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm import contamination, jaccard, lines, quality, segmentation
from pitsports.llm.common import settle, unpacked, with_row_key

#: SQL can express neither the hashed model of the first stage nor the sampling of the last.
ORACLE_SQL = None
#: Near-duplicates share at least 80 % of their five-word shingles.
NEAR = jaccard.Rule(width=5, num=80, den=100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    kept = quality.judged(docs, labels).where("kept")
    return kept.select(*unpacked(kept))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their boilerplate lines; n_chars follows the text. Documents left without text go."""
    out = lines.cleaned(docs, min_words=1).where("_n_removed = 0 or trim(_text) <> ''")
    return out.select(*unpacked(out, text=F.col("_text"), n_chars=F.length("_text").cast(docs.schema["n_chars"].dataType)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one of smallest id (null ids last), of each connected group of near-duplicates."""
    return jaccard.first_of_groups(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, told apart by row key: ids may be null or repeated."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = with_row_key(docs)
    found = contamination.search(keyed.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), items)
    found = settle(found.select(F.col("doc_id").alias("_row")).distinct())
    return keyed.join(found, "_row", "left_anti").select(*unpacked(keyed))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document: doc_id, sample, ids, n_tokens, ids_crc32, log_prob, score, inclusion, round_trip."""
    return segmentation.with_digest(segmentation.encode(docs.select("doc_id", "text"), segmentation.model_path()))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
