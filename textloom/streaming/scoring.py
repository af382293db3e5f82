"""Scoring of documents as they arrive, against a corpus that does not change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textloom.engine import Engine


def score_stream(engine: Engine, docs: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Check every micro-batch of a stream of (doc_id, text) and append its scores to ``out``; each batch has a folder, so that a repeated one replaces itself."""

    def score(batch: DataFrame, epoch: int) -> None:
        engine.check(batch, **options).scores.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return docs.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
