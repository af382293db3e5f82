"""SimHash near-dedup with BK-trees.

Fingerprints: majority bits of the XXH64 hashes (seed 42) of a text's word
shingles. Documents link when their fingerprints differ in at most ``radius``
bits, and classes are the connected components of links.

Search: equal fingerprints are one node. Two fingerprints within ``radius`` of
each other agree on at least k of radius + k bit blocks, so each node goes to
the shard of every choice of k blocks, and k grows with the number of nodes to
keep shards near ``shard_rows``; nothing is lost at any k. Each shard's nodes
form BK-trees of at most ``tree_rows`` nodes: children are keyed by their
integer Hamming distance to the parent, and a search for v at a node at
distance d follows only the edges d - radius to d + radius. A shard too large
for one tree is dealt over several, and every tree is sent the nodes of the
trees before it as queries, so that a hot shard is split over tasks. Trees
return a spanning forest of the links they find; components are joined from
those forests over the cluster.

Defined results: null, empty and blank texts have fingerprint zero and link
with each other; a text shorter than a shingle is one shingle; words are split
at the six ASCII white space characters and only A-Z is lower-cased; rows with
null or repeated ids are rows like others (the smallest id of a class is its
smallest non-null id, null if there is none); an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import written

LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """64 bits; each is 1 if set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    rows = np.zeros(-(-n // 255) * 255, np.uint64)
    rows[:n] = hashes
    rows = rows.reshape(-1, 255)
    out = 0
    for k in range(8):  # bit k of each of the eight bytes; a byte's sum over 255 rows can't overflow
        sums = ((rows >> np.uint64(k)) & LANES).sum(axis=1)
        for byte, count in enumerate(sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)):
            if 2 * int(count) > n:
                out |= 1 << (8 * byte + k)
    return out


def simhash(text: bytes | None, shingle_words: int) -> int:
    words = (text or b"").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle_words] + 1).tolist()]
    return majority(np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, _row, _fp): _row tells rows with one id apart by their text, _fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((simhash(t, shingle_words) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=[id_col, "_row", "_fp"])

    rows = docs.select(id_col, F.xxhash64(text_col).alias("_row"), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, _row long, _fp long")


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Values must be distinct."""
        at = 0
        if self.values:
            while True:
                d = (self.values[at] ^ value).bit_count()
                if d not in self.children[at]:
                    self.children[at][d] = len(self.values)
                    break
                at = self.children[at][d]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        found, values, children = [], self.values, self.children
        todo = [0] if values else []
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(values[at])
            low, high = d - radius, d + radius
            todo += [to for step, to in children[at].items() if low <= step <= high]
        return found


class _Union:
    """Union-find that says whether a link joins two sets."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bit_masks(radius: int, k: int) -> list[int]:
    """For each choice of k of radius + k blocks of 64 bits: the bits of those blocks."""
    cuts = [64 * i // (radius + k) for i in range(radius + k + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, k)]


def _tree_links(radius: int):
    def run(batches):
        now, tree, union = None, BKTree(), _Union()
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            a, b = [], []
            for key, member, fp in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_numpy().view(np.uint64).tolist(), strict=True):
                if key != now:
                    now, tree, union = key, BKTree(), _Union()
                for other in tree.within(fp, radius):
                    if union.join(fp, other):
                        a.append(fp)
                        b.append(other)
                if not member:  # false sorts first: members come before what is only asked
                    tree.add(fp)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def link_forest(nodes: DataFrame, radius: int, n_nodes: int, shard_rows: int = 64, tree_rows: int = 4096) -> DataFrame:
    """(a, b): links that connect what links within ``radius`` connect, for distinct ``nodes(_fp)``."""
    k = next((k for k in range(1, 6) if n_nodes <= shard_rows << (64 * k // (radius + k))), 6)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    shards = F.array(*[F.struct(F.lit(i).alias("s"), F.col("_fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(bit_masks(radius, k))])
    rows = nodes.select("_fp", F.explode(shards).alias("_x")).select("_fp", F.col("_x.s").alias("_s"), F.col("_x.k").alias("_k"))
    large = rows.groupBy("_s", "_k").count().where(F.col("count") > tree_rows).select("_s", "_k", F.ceil(F.col("count") / tree_rows).alias("_n"))
    rows = rows.join(large, ["_s", "_k"], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    rows = rows.withColumn("_tree", F.pmod(F.xxhash64("_fp"), F.col("_n"))).withColumn("_to", F.explode(F.sequence(F.col("_tree"), F.col("_n") - 1)))
    sent = rows.select("_s", "_k", "_to", (F.col("_to") != F.col("_tree")).alias("_asked"), "_fp").repartition("_s", "_k", "_to")
    return sent.sortWithinPartitions("_s", "_k", "_to", "_asked", "_fp").mapInArrow(_tree_links(radius), "a long, b long")


def near_classes(prints: DataFrame, radius: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(_fp, component_id, _rep): each distinct fingerprint's class, as its smallest id, and the smallest (id, row) of the class."""
    place = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("_row").alias("r"))
    nodes = written(prints.groupBy("_fp").agg(F.min(place).alias("_rep")), "simhash-nodes")
    roots = connected_components(link_forest(nodes.select("_fp"), radius, nodes.count()))
    rooted = nodes.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("_root", F.coalesce("component", "_fp")).drop("component")
    lone = rooted.groupBy("_root").agg(F.min("_rep").alias("_rep"))
    return rooted.select("_fp", "_root").join(lone, "_root").select("_fp", F.col("_rep.i").alias("component_id"), "_rep")


def simhash_classes(docs: DataFrame, shingle_words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, _row, fingerprint, component_id, _kept), one row per row of ``docs``."""
    prints = written(fingerprints(docs, shingle_words, id_col, text_col), "simhash-prints")
    out = prints.join(near_classes(prints, radius, id_col), "_fp")
    kept = F.col(id_col).eqNullSafe(F.col("_rep.i")) & (F.col("_row") == F.col("_rep.r"))
    return out.select(id_col, "_row", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id", kept.alias("_kept"))


def row_key(text_col: str = "text") -> Column:
    return F.xxhash64(text_col)


def keep_one(docs: DataFrame, shingle_words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id (and text hash); of rows alike in both, any one."""
    kept = simhash_classes(docs, shingle_words, radius, id_col, text_col).where("_kept").select(F.col(id_col).alias("id"), F.col("_row").alias("of")).distinct()
    return rows_of(docs, kept, id_col, text_col)


def rows_of(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each of ``kept(id, of)``, of being the text's hash. The columns of ``docs`` may have any names."""
    kind = f"struct<i:{docs.schema[id_col].dataType.simpleString()},r:bigint>"
    key = lambda i, r: F.struct(i.alias("i"), r.alias("r")).cast(kind)  # noqa: E731  one key of one type, never null, so that what the join deals out is not dealt out again
    rows = docs.select(key(F.col(f"`{id_col}`"), row_key(f"`{text_col}`")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))
    kept = kept.select(key(F.col("id"), F.col("of")).alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("all.*")
