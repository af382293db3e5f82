"""Registry of encoders (text to unit vector), pair scorers and classifiers. Only offline ones are built in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import shingles, words

DIM = 256


def _bags(batches):
    for batch in batches:
        out = np.zeros((batch.num_rows, DIM))
        for row, grams in zip(out, batch.column(1).to_pylist(), strict=True):
            for g in grams:
                h = xxhash.xxh64_intdigest(g)
                row[h % DIM] += 1 if h >> 63 else -1
        norm = np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)
        flat = pa.array((out / norm).astype(np.float32).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * DIM), flat)], names=["id", "embedding"])


def hashed_bag(docs: DataFrame, id_col: str, text_col: str, size: int = 1) -> DataFrame:
    """(id, embedding): signed counts of hashed shingles of ``size`` words, normalised."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), shingles(words(F.col(text_col)), size).alias("_g"))
    return rows.mapInArrow(_bags, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


#: Name to (documents, id column, text column) -> (id, embedding).
ENCODERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "hashed-words": hashed_bag,
    "hashed-pairs": lambda d, i, t: hashed_bag(d, i, t, 2),
}
#: Name to (query text, matched text) -> logit.
PAIR_SCORERS: dict[str, Callable[[Column, Column], Column]] = {}
#: Name to text -> probability of machine-made text; 0.5 where there is no model.
CLASSIFIERS: dict[str, Callable[[Column], Column]] = {"none": lambda text: F.lit(0.5)}
#: Name to text -> perplexity; NaN where there is no model.
PERPLEXITIES: dict[str, Callable[[Column], Column]] = {"none": lambda text: F.lit(float("nan"))}
#: Name to array of words -> array of stems.
STEMMERS: dict[str, Callable[[Column], Column]] = {"none": lambda tokens: tokens}
