"""A table of embeddings by model and chunk: kept up to date, checked, dropped, and filled ahead of use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.relational import cache_key, missing


def _folder(path: str, model: str) -> str:
    return f"{path.rstrip('/')}/model={model}"


def stored(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """(key, embedding) of a model; None if nothing is stored or what is stored is of no use: other columns, repeated keys, or vectors that are null or of several lengths."""
    try:
        rows = spark.read.parquet(_folder(path, model)).select("key", F.col("embedding").cast("array<float>").alias("embedding"))
    except AnalysisException:
        return None
    bad = rows.agg(F.count_distinct(F.coalesce(F.size("embedding"), F.lit(-1))).alias("lengths"), F.min(F.coalesce(F.size("embedding"), F.lit(-1))).alias("least"), F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys")).first()
    return rows if bad["n"] == 0 or (bad["lengths"] == 1 and bad["least"] > 0 and bad["n"] == bad["keys"]) else None


def invalidate(spark: SparkSession, path: str, model: str) -> None:
    """Drop what is stored of a model; nothing happens if there is nothing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, model))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def embeddings(spark: SparkSession, path: str, model: str, chunks: DataFrame, encode: Callable[[DataFrame, str, str], DataFrame], id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id_col, embedding) of all ``chunks``: those stored are read, the others encoded and stored. A store that is of no use is made anew."""
    keyed = chunks.select(id_col, text_col, cache_key(F.col(id_col), F.col(text_col)).alias("key"))
    have = stored(spark, path, model)
    if have is None:
        invalidate(spark, path, model)
    new = keyed if have is None else missing(keyed, have, "key")
    new = new.dropDuplicates(["key"])
    encode(new.select("key", text_col), "key", text_col).select("key", "embedding").write.mode("append").parquet(_folder(path, model))
    return keyed.join(spark.read.parquet(_folder(path, model)).select("key", "embedding"), "key").select(id_col, "embedding")


def prewarm(spark: SparkSession, path: str, models: dict[str, Callable], chunks: DataFrame) -> dict[str, int]:
    """Fill the store of every model ahead of use; the number of chunks each has."""
    return {name: embeddings(spark, path, name, chunks, encode).count() for name, encode in models.items()}
