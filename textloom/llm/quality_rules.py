"""Quality rules: hashed n-gram log-likelihood ratio, length-normalised, with a fixed threshold.

Every run of ``n`` bytes of a text is hashed into one of 2**16 buckets. Bucket
counts over all documents give the raw-corpus multinomial, counts over the
trusted documents give the target multinomial (one is added to each bucket of
both), and a document's score is its mean log(target / raw) per n-gram. Documents that
fail the base rules or score below ``threshold`` (nats per n-gram) are rejected.

The trusted target is at most ``max_trusted`` labelled documents (a documented
bound, so their ids can be broadcast), those with the smallest id hashes; raw
counts cover every document. The ratio table has 2**16 entries at any size.

Base rules on words ``[^\\x20\\x09-\\x0D]+``: fewer than 50 words, or more than half
of the words in 3-word windows that occur twice or more.

Defined results: a null text has no words and fails; a text of fewer than n
bytes scores 0; without trusted documents every score is 0; null labels and
label rows for absent documents count for nothing; documents with one id share
its label; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import FEW_TEXTS, lean, written

BUCKET_BITS = 16
#: Odd multipliers for mixing 64-bit words.
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Fixed by the rules: characters that count as symbols, and white space.
SYMBOLS, SPACE = b"#*$%&|<>", b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNK = 1 << 22


def grams(text: bytes, n: int):
    """Arrays of the bucket numbers of all n-byte runs, a few million at a time."""
    whole = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(whole) - n + 1), CHUNK):
        x = whole[start : start + CHUNK + n - 1].astype(np.uint64)
        size = len(x) - n + 1
        h = x[:size].copy()
        for i in range(1, n):
            h = h << np.uint64(8) | x[i : size + i]
        h *= TURN
        h ^= h >> np.uint64(32)
        h *= MIX
        yield (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _counts(n: int):
    """Per partition and bucket: n-grams in all texts, and in trusted ones. Texts are put together up to a chunk, for speed."""

    def run(batches):
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in grams(text or b"", n):
                    if len(found) > 1 << 13:
                        counts = np.bincount(found, minlength=1 << BUCKET_BITS)
                        total[0] += counts
                        if trusted:
                            total[1] += counts
                    else:
                        np.add.at(total[0], found, 1)
                        if trusted:
                            np.add.at(total[1], found, 1)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["bucket", "raw", "target"])

    return run


def trusted_ids(labels: DataFrame, max_trusted: int, id_col: str = "doc_id") -> DataFrame:
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_trusted")).distinct()
    return good.orderBy(F.xxhash64("_trusted"), "_trusted").limit(max_trusted)


def ratio_table(docs: DataFrame, labels: DataFrame, n: int = 4, max_trusted: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / raw) of each bucket; zeros where there is no trusted text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(trusted_ids(labels, max_trusted, id_col)), F.col("_id") == F.col("_trusted"), "left")
    rows = rows.select("text", F.col("_trusted").isNotNull().alias("trusted"))
    counts = rows.mapInArrow(_counts(n), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    both = np.zeros((2, 1 << BUCKET_BITS))
    at = counts["bucket"].to_numpy()
    both[0][at], both[1][at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    if not both[1].any():
        return np.zeros(1 << BUCKET_BITS)
    share = np.log(both + 1) - np.log(both.sum(axis=1, keepdims=True) + both.shape[1])
    return share[1] - share[0]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def n_repeated(hashes: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; windows are told apart by 64-bit hashes."""
    if len(hashes) < 3:
        return 0
    keys = (hashes[:-2] * MIX ^ hashes[1:-1]) * TURN + (hashes[2:] >> np.uint64(7) ^ hashes[2:] * MIX)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    words = np.zeros(len(hashes), bool)
    for i in range(3):
        words[i : len(words) - 2 + i] |= again
    return int(words.sum())


def rule_counts(text: bytes | None, hashes: dict) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or b""
    words = text.split()
    solid = text.translate(None, SPACE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), n_repeated(h)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_quality(docs: DataFrame, labels: DataFrame, n: int = 4, threshold: float = -0.5, max_trusted: int = 1 << 18, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", rest: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the five counts (long), base_failed, score (double), kept; then the columns ``rest`` as they are."""
    table = docs.sparkSession.sparkContext.broadcast(ratio_table(docs, labels, n, max_trusted, id_col, text_col))

    others = [c for c in rest if c != text_col]
    places = [1 if c == text_col else 2 + others.index(c) for c in rest]  # the text goes to Python once

    def run(batches):
        hashes, ratios = _WordHashes(), table.value
        for batch in batches:
            counts, scores = [], []
            for text in batch.column(1).to_pylist():
                counts.append(rule_counts(text, hashes))
                parts = [(ratios[g].sum(), len(g)) for g in grams(text or b"", n)]
                scores.append(sum(s for s, _ in parts) / max(1, sum(k for _, k in parts)))
            c = np.array(counts, np.int64).reshape(-1, 5)
            failed = (c[:, 0] < min_words) | (100 * c[:, 4] > max_repeat_percent * c[:, 0])
            s = np.array(scores, np.float64)
            columns = [batch.column(0), *(pa.array(c[:, i]) for i in range(5)), pa.array(failed), pa.array(s), pa.array(~failed & (s >= threshold)), *(batch.column(at) for at in places)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *NAMES, "base_failed", "score", "kept", *(f"_rest_{c}" for c in rest)])

    kinds = {c: "binary" if c == text_col else docs.schema[c].dataType.simpleString() for c in rest}
    fields = [f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", *(f"{x} long" for x in NAMES), "base_failed boolean", "score double", "kept boolean", *(f"`_rest_{c}` {k}" for c, k in kinds.items())]
    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"), *[F.col(f"`{c}`").alias(f"_rest_{c}") for c in rest if c != text_col])
    scored = rows.mapInArrow(lean(run), ", ".join(fields))
    return scored.withColumn(f"_rest_{text_col}", F.col(f"`_rest_{text_col}`").cast(docs.schema[text_col].dataType)) if text_col in rest else scored


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they had. They are written in the shared folder, as whole texts pass Python, and few of them at a time."""
    scored = score_quality(docs, labels, rest=tuple(docs.columns), **options)
    return written(scored.where("kept").select(*[F.col(f"`_rest_{c}`").alias(c) for c in docs.columns]), "good", during=FEW_TEXTS)
