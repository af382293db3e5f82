"""Near-dedup by SimHash, made whole: fingerprints within ``radius`` link, and so does every pair of texts with Jaccard similarity of ``num / den`` or more.

Fingerprints and their classes are those of the SimHash operator (BK-trees). At
a similarity of 0.8 some ten of 64 bits differ, beyond any radius at which trees
skip much, so links of that similarity are searched by the shingles themselves.
Texts are sets of the XXH64 hashes of their word shingles, equal sets are one
node, and classes are the connected components of both kinds of links.

Search by shingles: hashes are ordered, those frequent in a sample of texts last. Two sets
of Jaccard num / den or more share a hash among the first m - ceil(m num / den)
+ 1 of each (m is a set's size), so the pairs that meet there hold all links;
sizes, the places of the first common hash, and maps of ``MAP_BITS`` bits rule
out most others (each bit that only one set has is a hash the other lacks). Of the texts
of what is left, wider maps are made (``WIDE_BITS`` a hash) and rule out most of the rest, so that
few texts are moved. What is left then is compared whole. The sample decides the cost alone: nothing is lost at
any order. First each hash's smallest set meets the others; sets that these links and the
fingerprints already put into one class are not paired again, as classes are all that is
asked for, so a large group of near copies does not cost its square.

Defined results: null, empty and blank texts have the empty set and are one
class; a text shorter than a shingle is one shingle; words are split at the six
ASCII white space characters and only A-Z is lower-cased; rows with null or
repeated ids are rows like others; shingles and sets are told apart by 64-bit
hashes; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .simhash_dedup import majority, near_classes, rows_of
from .storage import CLEANUP, FEW_TEXTS, erase, lean, settings, written

SAMPLE_DOCS, MAX_FREQUENT, MAP_BITS, WIDE_BITS = 1 << 13, 1 << 16, 1024, 8


def shingle_hashes(text: bytes | None, shingle_words: int) -> np.ndarray:
    """Of every shingle in order, repeats included."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle_words] + 1).tolist()]
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def shingle_set(text: bytes | None, shingle_words: int) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(shingle_hashes(text, shingle_words))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("binary").alias("_text"))


def frequent_shingles(docs: DataFrame, shingle_words: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles in three texts or more of a sample."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle_words).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(max(1, docs.count() // SAMPLE_DOCS))) == 0)
    counts = _texts(some, text_col).mapInArrow(run, "h long").groupBy("h").count().where("count >= 3")
    with settings(docs.sparkSession, CLEANUP):
        found = counts.orderBy(F.desc("count")).limit(MAX_FREQUENT).collect()
    h, n = np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["count"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def bit_map(s: np.ndarray, size: int = MAP_BITS) -> bytes:
    bits = np.zeros(size, np.uint8)
    bits[(s % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def wide_map(s: np.ndarray) -> bytes:
    """A map of ``WIDE_BITS`` bits or more a hash, their number a power of two, so that a wider one can be folded."""
    return bit_map(s, 1 << max(MAP_BITS, WIDE_BITS * len(s) - 1).bit_length())


def most_common(n: int, m: int, a: bytes, b: bytes) -> int:
    """No more hashes than this are common to sets of n and m hashes with these wide maps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0).view(np.uint64) for v in (x, y))
    lone = [int(np.bitwise_count(v).sum(dtype=np.int64)) for v in (x & ~y, y & ~x)]
    return min(n - lone[0], m - lone[1])


def _heads(shingle_words: int, num: int, den: int, frequent, names: list[str]):
    hot, counts = frequent

    def run(batches):
        for batch in batches:
            sets, sizes, heads, maps, prints = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_hashes(text, shingle_words)
                prints.append(majority(s))
                s = np.unique(s)
                n = len(s)
                sets.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(n)
                maps.append(bit_map(s))
                if len(hot) and n:
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    s = s[np.argsort(np.where(hot[at] == s, counts[at], 0), kind="stable")]
                heads.append(s[: n - -(-n * num // den) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))], names=names)

    return run


def _may_link(num: int, den: int):
    """(x, y, sizes, maps) to the pairs whose maps leave room for enough common hashes."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, MAP_BITS // 64) for i in (4, 5))
            common = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
            at = pa.array(np.flatnonzero(common * (num + den) >= num * (n + m)))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (0, 1)], names=["x", "y"])

    return run


def _widely(shingle_words: int):
    """Texts to their wide maps."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, shingle_words) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_map(s) for s in sets], pa.binary())], names=["_set", "n", "wide"])

    return run


def _may_link_widely(num: int, den: int):
    """(x, y, sizes, wide maps) to the pairs whose maps leave room for enough common hashes."""

    def run(batches):
        for batch in batches:
            n, m, a, b = (batch.column(i).to_pylist() for i in range(2, 6))
            at = pa.array([k for k, row in enumerate(zip(n, m, a, b, strict=True)) if most_common(*row) * (num + den) >= num * (row[0] + row[1])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (0, 1)], names=["x", "y"])

    return run


def _similar(shingle_words: int, num: int, den: int):
    """Rows in order of ``g``, its own text (``other`` null) before those of its candidates, to links."""

    def run(batches):
        now, own = None, None
        for batch in batches:
            a, b = [], []
            for g, other, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingle_set(text, shingle_words)
                if other is None:
                    now, own = g, s
                    continue
                assert g == now
                if len(np.intersect1d(own, s, assume_unique=True)) * (num + den) >= num * (len(own) + len(s)):
                    a.append(g)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def _occurrences(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select("_set", "_size", *more, F.posexplode("_head").alias("_at", "_h")).select("_h", "_set", "_size", *more, (F.col("_size") - F.col("_at")).alias("_left"))


def _may(a: str, b: str, num: int, den: int):
    return (F.col(f"{a}._size") * den >= F.col(f"{b}._size") * num) & (F.least(f"{a}._left", f"{b}._left") * (num + den) >= (F.col(f"{a}._size") + F.col(f"{b}._size")) * num)


def first_candidates(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): of each head hash, the smallest set with each other one, if they may link. As many as there are hashes at most, whatever the groups' sizes."""
    rows = _occurrences(nodes).withColumn("a", F.min(F.struct("_size", "_set", "_left")).over(Window.partitionBy("_h"))).withColumn("b", F.struct("_size", "_set", "_left"))
    return rows.where((F.col("a._set") != F.col("_set")) & _may("a", "b", num, den)).select(F.col("a._set").alias("x"), F.col("_set").alias("y")).distinct()


def candidates(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): all pairs of ``nodes(_set, _size, _head, _class)`` that may link and are not in one class already, x the smaller set."""
    rows = _occurrences(nodes, "_class")
    a, b = rows.alias("a"), rows.alias("b")
    smaller = (F.col("a._size") < F.col("b._size")) | ((F.col("a._size") == F.col("b._size")) & (F.col("a._set") < F.col("b._set")))
    met = (F.col("a._h") == F.col("b._h")) & (F.col("a._class") != F.col("b._class"))
    return a.join(b, met & smaller & _may("a", "b", num, den)).select(F.col("a._set").alias("x"), F.col("b._set").alias("y")).distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle_words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): those of ``pairs(x, y)`` of nodes with Jaccard num / den or more, each compared whole. The tables on the way are deleted."""
    for k in "xy":
        pairs = pairs.join(nodes.select(F.col("_set").alias(k), F.col("_size").alias(f"n{k}"), F.col("_map").alias(f"m{k}")), k)
    pairs = written(pairs.select("x", "y", "nx", "ny", "mx", "my").mapInArrow(lean(_may_link(num, den)), "x long, y long"), "shingle-pairs")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("_set")).distinct().join(nodes, "_set").select("_set", F.col("_rep.i").alias("_id"), F.col("_rep.r").alias("_of"))
    wanted = written(wanted, "shingle-wanted")  # as a table of known size it is broadcast while small, and texts stay where they are
    rows = docs.select(F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_row"), F.col(text_col).cast("binary").alias("_text"))
    texts = rows.join(wanted, (F.col("_row") == F.col("_of")) & F.col("_i").eqNullSafe(F.col("_id"))).groupBy("_row", "_set").agg(F.first("_text").alias("_text"))
    texts = written(texts.select("_set", "_text"), "shingle-texts")
    erase(wanted)
    maps = written(texts.select("_set", "_text").mapInArrow(lean(_widely(shingle_words)), "_set long, n long, wide binary"), "shingle-maps", during=FEW_TEXTS)
    left = pairs
    for k in "xy":
        left = left.join(maps.select(F.col("_set").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}")), k)
    left = written(left.select("x", "y", "nx", "ny", "wx", "wy").mapInArrow(lean(_may_link_widely(num, den)), "x long, y long"), "shingle-left", during=FEW_TEXTS)
    erase(maps)
    erase(pairs)
    pairs = left  # before texts are moved, one for each pair
    own = texts.join(pairs.select(F.col("x").alias("_set")).distinct(), "_set").select(F.col("_set").alias("g"), F.lit(None).cast("long").alias("other"), "_text")
    others = pairs.join(texts, pairs["y"] == texts["_set"]).select(F.col("x").alias("g"), F.col("y").alias("other"), "_text")
    met = own.unionByName(others).repartition("g").sortWithinPartitions("g", F.col("other").asc_nulls_first())
    links = written(met.mapInArrow(lean(_similar(shingle_words, num, den)), "a long, b long"), "shingle-links", during=FEW_TEXTS)
    erase(pairs)
    erase(texts)
    return links


def simhash_links(rows: DataFrame, radius: int, id_col: str) -> DataFrame:
    """(a, b): links of sets that connect what the classes of fingerprints connect: each set of a class with the smallest one."""
    classes = near_classes(rows.select(id_col, "_row", "_fp"), radius, id_col).select("_fp", "_rep")
    sets = written(rows.select("_set", "_fp").distinct().join(classes, "_fp").select("_set", "_rep"), "shingle-classes")
    least = sets.groupBy("_rep").agg(F.min("_set").alias("_least"), F.max("_set").alias("_most")).where("_least <> _most")
    same = lambda k: F.col(f"s._rep.{k}").eqNullSafe(F.col(f"l._rep.{k}"))
    return sets.alias("s").join(least.alias("l"), same("z") & same("i") & same("r")).select(F.col("_set").alias("a"), F.col("_least").alias("b")).where("a <> b")


def keep_one(docs: DataFrame, shingle_words: int = 5, num: int = 4, den: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id (and text hash); of rows alike in both, any one."""
    names = [id_col, "_row", "_set", "_size", "_head", "_map", "_fp"]
    frequent = frequent_shingles(docs, shingle_words, text_col)
    rows = docs.select(id_col, F.xxhash64(text_col).alias("_row"), F.col(text_col).cast("binary").alias("_text"))
    rows = written(rows.mapInArrow(lean(_heads(shingle_words, num, den, frequent, names)), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, _row long, _set long, _size int, _head array<long>, _map binary, _fp long"), "shingle-rows", during=FEW_TEXTS)
    place = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("_row").alias("r"))
    nodes = written(rows.groupBy("_set").agg(F.min(place).alias("_rep"), F.first("_size").alias("_size"), F.first("_head").alias("_head"), F.first("_map").alias("_map")), "shingle-nodes")
    links = simhash_links(rows, radius, id_col)
    erase(rows)
    similar = lambda pairs: similar_links(docs, nodes, pairs, shingle_words, num, den, id_col, text_col)
    links = links.unionByName(similar(first_candidates(nodes, num, den)))
    classes = connected_components(links).withColumnRenamed("node", "_set")
    labelled = nodes.join(classes, "_set", "left").withColumn("_class", F.coalesce("component", "_set"))
    links = links.unionByName(similar(candidates(labelled, num, den)))
    roots = connected_components(links).withColumnRenamed("node", "_set")
    kept = nodes.select("_set", "_rep").join(roots, "_set", "left").groupBy(F.coalesce("component", "_set")).agg(F.min("_rep").alias("_rep"))
    kept = written(kept.select(F.col("_rep.i").alias("id"), F.col("_rep.r").alias("of")), "shingle-kept")
    erase(nodes)  # before the texts are moved
    return rows_of(docs, kept, id_col, text_col)
