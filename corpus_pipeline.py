"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Rows that a stage takes as input are
all rows that the one before kept. Nulls may be in any column, texts may be empty
or very long, rows may be repeated, and tables may be empty; what becomes of such
rows is said below, and in the operators' modules.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, line_dedup, mixing, quality_rules, shingle_dedup
from textloom.llm.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts, and texts that repeat themselves, among them. Repeated rows share their fate; an empty table stays empty."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all documents but the first that has them; every document stays, null and empty texts as they are. n_chars of a changed text is counted again."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("_ld_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id (null last): SimHash fingerprints of five-word shingles within 4 bits link, and so do all pairs with a Jaccard similarity of 0.8 or more.

    Null, empty and blank texts are one class; of rows alike in id and text one stays.
    Fingerprints alone can't tell that similarity (some ten of 64 bits differ), so shingles are compared as well.
    """
    return shingle_dedup.keep_one(docs, shingle_words=5, num=4, den=5, radius=4).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them, to the nearest whole time; texts without words stay once, a null source is one of its own, and rows of one id are taken alike."""
    return mixing.mixed(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, decoded_sha256): a null text has no ids; the digest is that of the bytes that the ids decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    told = lambda c: (c.ids.astype(np.int32), len(c), hashlib.sha256(c.decoded()).hexdigest())
    return byte_bpe.encode_with(docs, ranks, public_tokenizers.PATTERN, told, "ids array<int>, n_tokens long, decoded_sha256 string", ["ids", "n_tokens", "decoded_sha256"], rest=("lang", "source"), max_frequent=1 << 18)


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mix), ("byte-level BPE", encode)]

#: Hashed likelihood ratios, similarities and ranked merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
