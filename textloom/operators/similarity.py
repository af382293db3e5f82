"""Similarity joins: MinHash candidates, exact and windowed Jaccard, vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import shingles, words
from textloom.operators import set_search as search

SLOTS, BANDS, ROWS = 128, 37, 3
PRIME = (1 << 31) - 1


def hash_factors(n: int = SLOTS) -> list[tuple[int, int]]:
    """Multiplier and addend of each hash function, from a linear congruential rule so that SQL can state them too."""
    out, x = [], 12345
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % (1 << 31)
            pair.append(x % (PRIME - 1) + 1)
        out.append((pair[0], pair[1]))
    return out


def shingle_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, shingle): one row per distinct shingle, with their number."""
    d = docs.select(id_col, shingles(words(F.col(text_col))).alias("_s"))
    return d.select(id_col, F.size("_s").alias("n"), F.explode("_s").alias("shingle"))


def minhash(shingle_set: Column) -> Column:
    """Array of 128 minima of (a h + b) mod 2^31 - 1, h being 28 bits of a shingle's MD5; the prime where there is no shingle.

    One pass over the array: a fold keeps all minima, so nothing is exploded or shuffled.
    """
    hashes = F.transform(shingle_set, lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 7), 16, 10).cast("bigint"))
    least = lambda a, b: F.array_min(F.concat(F.transform(hashes, lambda h: (h * a + b) % PRIME), F.array(F.lit(PRIME).cast("bigint"))))
    return F.array(*[least(a, b) for a, b in hash_factors()])


def _signatures(batches):
    factors = np.array(hash_factors(), np.int64)
    for batch in batches:
        hashes, out = batch.column(1), []
        offsets, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
        for a, b in zip(offsets, offsets[1:], strict=False):
            h = values[a:b]
            least = np.full(SLOTS, PRIME, np.int64)
            for at in range(0, len(h), 4096):
                x = (h[at : at + 4096, None] * factors[:, 0] + factors[:, 1]) % PRIME
                np.minimum(least, x.min(axis=0), out=least)
            out.append(least)
        flat = np.concatenate(out) if out else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * SLOTS), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "signature"])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, signature): as :func:`minhash`, in NumPy blocks; without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    hashed = docs.select(F.col(id_col).alias("id"), F.transform(shingles(words(F.col(text_col))), lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 7), 16, 10).cast("bigint")).alias("h"))
    return hashed.mapInArrow(_signatures, f"id {kind}, signature array<bigint>").withColumnRenamed("id", id_col)


def jaccard_estimate(a: Column, b: Column) -> Column:
    """The share of slots in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SLOTS))


def band_rows(sigs: DataFrame, id_col: str) -> DataFrame:
    """(id, band, key): 37 bands of 3 slots; those that share a key are candidates (threshold 0.3)."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.md5(F.array_join(F.slice("signature", b * ROWS + 1, ROWS), ",").cast("binary")).alias("key")))
    return sigs.select(id_col, F.explode(bands).alias("_b")).select(id_col, "_b.band", "_b.key")


def lsh_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Distinct (left id, right id) that share a band, from two tables of signatures."""
    return band_rows(left, left_id).join(band_rows(right, right_id), ["band", "key"]).select(left_id, right_id).distinct()


def slot_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, min_equal: int = 27) -> DataFrame:
    """(left id, right id, equal) with ``min_equal`` slots or more in common: every pair whose estimate is 0.21 or more, by an equi-join on slots."""
    slots = lambda d, i: d.select(i, F.posexplode("signature").alias("slot", "minimum"))
    met = slots(left, left_id).join(slots(right, right_id), ["slot", "minimum"])
    return met.groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("equal")).where(F.col("equal") >= min_equal)


def jaccard_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, min_score: float) -> DataFrame:
    """(left id, right id, common, jaccard) of shingle rows whose Jaccard is ``min_score`` or more."""
    a = left.select(left_id, F.col("n").alias("_n"), "shingle")
    b = right.select(right_id, F.col("n").alias("_m"), "shingle")
    met = a.join(b, "shingle").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("common"), F.first("_n").alias("_n"), F.first("_m").alias("_m"))
    return met.withColumn("jaccard", F.col("common") / (F.col("_n") + F.col("_m") - F.col("common"))).drop("_n", "_m").where(F.col("jaccard") >= min_score)


# Sets in a batch of the search, and sets in a block of comparisons.
ROUND_TEXTS, ROUND_PAIRS = 1 << 12, 1 << 10


def similar_sets(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, best: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, set, n) of every text that has shingles, and (x, y, common, jaccard) of all pairs x < y of unlike sets with Jaccard ``num / den`` or more.

    Equal sets are one. The search is that of :mod:`set_search`. Candidates are compared in blocks:
    a set's label is the smallest set that it or a candidate of it is, and a pair goes to the block of its
    first set's label, so that a group of near copies is moved once; few labels share a block, many sets of one label are split.
    With ``best``, links that are not among either set's so many best of their block may be left out, ties with these never.
    Shingles and sets are told apart by 64-bit hashes.
    """
    from textloom.llm.storage import erase, lean, written  # that package may be absent; only this needs it

    kind, few = docs.schema[id_col].dataType.simpleString(), {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("_text"))
    plain = F.trim(F.regexp_replace(F.lower("_text"), r"[^\p{L}\p{N}_]+", " ")).alias("plain")
    rows = written(given.select("id", "row", plain).mapInArrow(lean(search.parsed()), f"id {kind}, row long, set long, n long, s binary"), "set-rows", during=few)
    members = written(rows.select("id", "set", "n"), "members")
    nodes = written(rows.groupBy("set").agg(F.min(F.struct("id", "row")).alias("of"), F.first("s").alias("s")), "set-nodes", during=few)
    erase(rows)
    places = written(nodes.select("set", "of"), "set-places")
    parts = nodes.select("set", "s").mapInArrow(lean(search.dealt(ROUND_TEXTS)), "range int, batch long, part binary")
    shared = written(parts.groupBy("range").applyInArrow(search.frequent, "range int, batch long, part binary"), "set-shingles", during=few)
    erase(nodes)
    first = shared.groupBy("batch").applyInArrow(search.heads(num, den), "range int, part binary")
    pairs = written(first.groupBy("range").applyInArrow(search.met(num, den), "x long, y long").distinct(), "set-pairs")
    erase(shared)
    ways = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = written(ways.groupBy("x").agg(F.least("x", F.min("y")).alias("label")), "set-labels")
    sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / ROUND_PAIRS).alias("cuts"))
    bins = max(1, labels.count() // ROUND_PAIRS)
    cut = lambda k: F.pmod(F.xxhash64(k), F.col("cuts"))
    block = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(-1 - F.pmod(F.xxhash64("label", cut("x"), cut("y")), F.lit(1 << 48)))
    placed = written(pairs.join(labels.join(sizes, "label"), "x").select(block.alias("block"), "x", "y"), "set-blocks")
    erase(pairs)
    wanted = labels.join(places, F.col("x") == F.col("set")).select("set", F.col("of.id").alias("_id"), F.col("of.row").alias("_row"))
    wanted = written(wanted, "wanted-sets")
    texts = given.join(wanted, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))).dropDuplicates(["set"]).select("set", plain)
    whole = written(texts.mapInArrow(lean(search.wholly()), "set long, s binary"), "whole-sets", during=few)
    moved = placed.select(F.col("block").alias("at"), F.explode(F.array("x", "y")).alias("set")).distinct().join(whole, "set")
    links = placed.groupBy("block").cogroup(moved.groupBy("at")).applyInArrow(search.compared(num, den, best), "x long, y long, common long, jaccard double")
    links = written(links, "set-links", during=few)
    for gone in (places, labels, placed, wanted, whole):
        erase(gone)
    return members, links


def similar_pairs(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, best: int | None = None, once: bool = False) -> DataFrame:
    """(a, b, common, jaccard): all ordered pairs of texts with Jaccard ``num / den`` or more, with ``once`` those with a < b; with ``best``, at least each text's so many best, smallest ids first at ties.

    Of a set's texts only the ``best`` + 1 with the smallest ids can then be among them.
    """
    members, links = similar_sets(docs, id_col, text_col, num, den, best)
    copies = members.groupBy("set").agg(F.first("n").alias("common"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    own = copies.select(F.col("set").alias("x"), F.col("set").alias("y"), "common", F.lit(1.0).alias("jaccard"))
    way = links.unionByName(own)
    if not once:
        way = way.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"), "common", "jaccard"))
    others = members
    if best is not None:
        others = members.withColumn("_rank", F.row_number().over(Window.partitionBy("set").orderBy("id"))).where(F.col("_rank") <= best + 1)
    left, right = members.select(F.col("set").alias("x"), F.col("id").alias("a")), others.select(F.col("set").alias("y"), F.col("id").alias("b"))
    found = way.join(left, "x").join(right, "y")
    if once:
        return found.where("a < b or x <> y and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "jaccard")
    return found.where("a <> b").select("a", "b", "common", "jaccard")


def window_bounds(lengths: list[int], has_word: list[bool], chars: int, stride: int, least: int) -> list[tuple[int, int]]:
    """Windows [i, j) of words: those that start within ``chars`` characters of word i; then on by ``stride``."""
    at = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])[:-1]
    ends, nexts = np.searchsorted(at, at + chars), np.searchsorted(at, at + stride)
    some = np.concatenate([[0], np.cumsum(has_word)])
    out, i, n = [], 0, len(lengths)
    while i < n:
        j = int(ends[i])
        if j - i < least or some[j] == some[i]:
            i += 1
            continue
        out.append((i, j))
        if j >= n:
            break
        i = max(i + 1, int(nexts[i]))
    return out


def text_windows(chunks: DataFrame, id_cols: list[str], text_col: str, chars: int = 400, stride: int = 100, least: int = 3) -> DataFrame:
    """(ids, win_no, first, last, window): the windows of each text's white-space words; last is exclusive."""
    kinds = [chunks.schema[c].dataType.simpleString() for c in id_cols]
    names = [*id_cols, "win_no", "first", "last", "window"]

    def run(batches):
        for batch in batches:
            rows = []
            for at, tokens in enumerate(batch.column(len(id_cols)).to_pylist()):
                flags = [any(c.isalnum() or c == "_" for c in w) for w in tokens]
                rows += [(at, k, i, j, " ".join(tokens[i:j])) for k, (i, j) in enumerate(window_bounds([len(w) for w in tokens], flags, chars, stride, least))]
            at, no, first, last, text = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(id_cols))), pa.array(no, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(text, pa.string())], names=names)

    rows = chunks.select(*id_cols, F.filter(F.split(text_col, r"[\s\p{Z}]+"), lambda x: x != "").alias("_w"))
    return rows.mapInArrow(run, ", ".join([*(f"{c} {k}" for c, k in zip(id_cols, kinds, strict=True)), "win_no long", "first long", "last long", "window string"]))


def windowed_matches(paras: DataFrame, chunks: DataFrame, candidates: DataFrame, para_id: str, chunk_id: str, min_score: float = 0.30) -> DataFrame:
    """(para id, chunk id, score, win_no, window): the best window of each candidate pair, the earliest at ties.

    Windows do not depend on the paragraph, so they are made once per chunk that is a candidate.
    """
    wanted = chunks.join(candidates.select(chunk_id).distinct(), chunk_id, "left_semi")
    windows = text_windows(wanted, [chunk_id], "text").withColumn("_w", shingles(words(F.col("window"))))
    p = paras.select(para_id, shingles(words(F.col("text"))).alias("_p"))
    met = candidates.select(para_id, chunk_id).join(p, para_id).join(windows, chunk_id)
    common = F.size(F.array_intersect("_p", "_w"))
    met = met.withColumn("score", common / (F.size("_p") + F.size("_w") - common)).where(F.col("score") >= min_score)
    best = met.groupBy(para_id, chunk_id).agg(F.max_by(F.struct("score", "win_no", "window"), F.struct("score", -F.col("win_no"))).alias("_b"))
    return best.select(para_id, chunk_id, "_b.score", "_b.win_no", "_b.window")


def best_per(matches: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The row of highest score per key; of equal ones that with the lowest ``tie``."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return matches.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def match_kind(score: Column) -> Column:
    return F.when(score >= 0.9, "exact").otherwise("near")


def pack_vectors(vectors: DataFrame, id_col: str, vec_col: str, block: int) -> DataFrame:
    """(block, ids, data): vectors in blocks of about ``block`` rows, dealt by a hash of the id."""

    def run(batches):
        for batch in batches:
            rows = [v for v in batch.column(1).to_pylist()]
            for at in range(0, len(rows), block):
                x = np.array(rows[at : at + block], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([np.array(batch.column(0).to_pylist()[at : at + block], np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int64())], names=["ids", "data", "dim"])

    return vectors.select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(run, "ids binary, data binary, dim long")


def cosine_top(queries: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, block: int = 4096, same: bool = False) -> DataFrame:
    """(q, c, cosine): each query's most similar corpus vector, the lowest id at ties; with ``same``, not the one with its own id.

    Every query meets every vector, as the measure is exact: blocks of queries meet
    blocks of the corpus in matrix products, each of which keeps one row per
    query; a partial maximum then leaves one row per query in each partition.
    """

    def run(batches):
        for batch in batches:
            for qi, qd, ci, cd, dim in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                q, c = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                order = np.argsort(c, kind="stable")
                c, y = c[order], np.frombuffer(cd).reshape(-1, dim)[order]
                s = np.round(np.frombuffer(qd).reshape(-1, dim) @ y.T, 9)
                if same:
                    s[q[:, None] == c[None, :]] = -np.inf
                at = s.argmax(axis=1)
                top = s[np.arange(len(q)), at]
                ok = top > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(c[at[ok]]), pa.array(top[ok])], names=["q", "c", "cosine"])

    a = pack_vectors(queries, id_col, vec_col, block).select(F.col("ids").alias("qi"), F.col("data").alias("qd"))
    b = pack_vectors(corpus, id_col, vec_col, block).select(F.col("ids").alias("ci"), F.col("data").alias("cd"), "dim")
    met = a.crossJoin(b).select("qi", "qd", "ci", "cd", "dim").mapInArrow(run, "q long, c long, cosine double")
    top = met.groupBy("q").agg(F.max(F.struct("cosine", (-F.col("c")).alias("m"))).alias("_t"))
    return top.select("q", (-F.col("_t.m")).alias("c"), F.col("_t.cosine").alias("cosine"))


def ensemble_vote(tops: list[DataFrame]) -> DataFrame:
    """(q, c, votes, score) from each model's (q, c, cosine): most votes win, the first model's at ties; score is the mean of those that agree."""
    all_tops = reduce(DataFrame.unionByName, [t.withColumn("_model", F.lit(i)) for i, t in enumerate(tops)])
    votes = all_tops.groupBy("q", "c").agg(F.count(F.lit(1)).alias("votes"), F.avg("cosine").alias("score"), F.min("_model").alias("_first"))
    w = Window.partitionBy("q").orderBy(F.desc("votes"), "_first")
    return votes.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select("q", "c", "votes", "score")


def reranked(matches: DataFrame, logit: str = "logit", min_p: float = 0.5) -> DataFrame:
    """Matches but exact ones take the logistic of their logit as score and the kind cross-encoder; below ``min_p`` they go."""
    p = 1 / (1 + F.exp(-F.col(logit)))
    exact = F.col("kind") == "exact"
    out = matches.where(exact | F.col(logit).isNull() | (p >= min_p))
    scored = ~exact & F.col(logit).isNotNull()
    return out.withColumn("score", F.when(scored, p).otherwise(F.col("score"))).withColumn("kind", F.when(scored, "cross-encoder").otherwise(F.col("kind"))).drop(logit)
