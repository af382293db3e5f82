"""Embedding near-dedup by an epsilon grid order join.

Unit vectors link when their cosine is at least ``threshold``, that is when
their distance is at most eps = sqrt(2 - 2 threshold). The principal directions
come from the second moments of all vectors (one d x d sum). Vectors are sorted
by the eps-grid cells of their ``lead`` leading principal coordinates, and the
sequence is cut into intervals of ``interval`` vectors. Pairs of intervals are
joined recursively from the whole sequence down, eight ways a level, and a pair
whose bounding boxes are more than eps apart is skipped with all below it: no
vector of one can link with any of the other. What is left is joined in tasks,
again halving both intervals and skipping distant ones, down to blocks of
``leaf`` vectors, whose cosines are one matrix product in double precision.

Equal vectors are one node with a count, so a group of copies costs one row. A
task returns link counts per node and a spanning forest of its links, never the
links themselves; components are joined from those forests over the cluster.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing; vectors of unlike lengths do not link,
those of each length are joined among themselves; null or repeated ids are rows like others,
and a component's id is its smallest non-null one; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .storage import written

FANOUT_BITS = 3
#: Boxes are compared with this much to spare, for rounding.
SPARE = 1e-9


def _unit(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are proper, and their unit vectors as doubles."""
    good = [v is not None and len(v) == dim and None not in v for v in rows]
    x = np.array([v for v, g in zip(rows, good, strict=True) if g], np.float64).reshape(-1, dim)
    most = np.abs(x).max(axis=1, initial=0.0)
    fine = np.isfinite(x).all(axis=1) & (most > 0)
    x = x[fine] / most[fine, None]
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x += 0.0  # no negative zeros, so that equal vectors are equal bytes
    at = np.flatnonzero(good)[fine]
    return at, x


def unit_vectors(vectors: DataFrame, dim: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, unit): unit is null where a vector is not proper."""

    def run(batches):
        for batch in batches:
            at, x = _unit(batch.column(1).to_pylist(), dim)
            out: list = [None] * batch.num_rows
            for i, row in zip(at.tolist(), x, strict=True):
                out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "unit"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, unit binary")


def principal_axes(nodes: DataFrame, dim: int) -> np.ndarray:
    """Columns: principal directions, largest first. Any orthonormal columns would give the same links."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "m"])

    sums = nodes.select("unit").mapInArrow(moments, "at long, m double").groupBy("at").agg(F.sum("m").alias("m")).toArrow()
    m = np.zeros(dim * dim)
    m[sums["at"].to_numpy()] = sums["m"].to_numpy()
    return np.ascontiguousarray(np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1])


def grid_sequence(nodes: DataFrame, axes: np.ndarray, eps: float, lead: int, interval: int) -> DataFrame:
    """(part, no, size, low, high, units): the intervals of the sorted sequence; low and high bound the leading coordinates."""
    dim, k = axes.shape[0], min(lead, axes.shape[0])

    def cells(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, dim)
            c = np.floor(x @ axes[:, :k] / eps).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, i]) for i in range(k))], names=["unit", *(f"c{i}" for i in range(k))])

    def cut(batches):
        part, no, held = TaskContext.get().partitionId(), 0, []

        def made(rows):
            x = np.frombuffer(b"".join(rows), np.float64).reshape(-1, dim) @ axes[:, :k]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([no], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([x.min(axis=0).tolist()]), pa.array([x.max(axis=0).tolist()]), pa.array([b"".join(rows)], pa.binary())],
                names=["part", "no", "size", "low", "high", "units"],
            )

        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= interval:
                yield made(held[:interval])
                held, no = held[interval:], no + 1
        if held:
            yield made(held)

    names = [f"c{i}" for i in range(k)]
    celled = nodes.select("unit").mapInArrow(cells, "unit binary, " + ", ".join(f"{c} long" for c in names))
    return celled.repartitionByRange(*names, "unit").sortWithinPartitions(*names, "unit").select("unit").mapInArrow(cut, "part long, no long, size long, low array<double>, high array<double>, units binary")


def _apart(a: str, b: str):
    """Squared distance between two boxes."""
    gap = lambda x, y: F.greatest(x - y, F.lit(0.0))
    parts = F.zip_with(F.zip_with(f"{a}.low", f"{b}.high", gap), F.zip_with(f"{b}.low", f"{a}.high", gap), lambda x, y: x * x + y * y)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def interval_pairs(intervals: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: pairs of intervals (by their place in the sequence) that may hold links."""
    boxes = intervals.select("seq", "low", "high")
    bits = max(1, (boxes.agg(F.max("seq")).first()[0] or 0).bit_length())
    levels = -(-bits // FANOUT_BITS)
    size = len(intervals.select("low").first()[0])
    pairs = None
    for level in range(levels, -1, -1):
        node = F.shiftright("seq", FANOUT_BITS * level)
        bound = lambda how, c: F.array(*[how(F.col(c)[i]) for i in range(size)]).alias(c)
        now = boxes.groupBy(node.alias("node")).agg(bound(F.min, "low"), bound(F.max, "high")).withColumn("up", F.shiftright("node", FANOUT_BITS))
        a, b = now.alias("a"), now.alias("b")
        if pairs is None:
            met = a.join(b, F.col("a.node") == F.col("b.node"))  # the one root with itself
        else:
            p = pairs.alias("p")
            met = p.join(a, F.col("p.a") == F.col("a.up")).join(b, F.col("p.b") == F.col("b.up"))
        pairs = written(met.where("a.node <= b.node").where(_apart("a", "b") <= eps * eps + SPARE).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), "interval-pairs")
    return pairs


def _joined(x, y, same: bool, threshold: float, eps: float, leaf: int, axes: np.ndarray):
    """Yields (rows of x, rows of y) that link, block by block; of x with itself each link once."""
    px, py = x @ axes, (y @ axes if not same else None)
    py = px if same else py

    def boxes(p):
        tree = {}
        todo = [(0, len(p))]
        while todo:
            lo, hi = todo.pop()
            tree[lo, hi] = p[lo:hi].min(axis=0), p[lo:hi].max(axis=0)
            if hi - lo > leaf:
                mid = lo + max(leaf, (hi - lo) // 2 // leaf * leaf)
                todo += [(lo, mid), (mid, hi)]
        return tree

    bx = boxes(px)
    by = bx if same else boxes(py)
    halves = lambda t, r: [r] if r[1] - r[0] <= leaf else [(r[0], m := r[0] + max(leaf, (r[1] - r[0]) // 2 // leaf * leaf)), (m, r[1])]
    todo = [((0, len(x)), (0, len(y)))]
    while todo:
        r, s = todo.pop()
        (rl, rh), (sl, sh) = bx[r], by[s]
        gap = np.maximum(np.maximum(rl - sh, sl - rh), 0.0)
        if gap @ gap > eps * eps + SPARE or same and s[1] <= r[0]:
            continue
        if r[1] - r[0] <= leaf and s[1] - s[0] <= leaf:
            hit = x[r[0] : r[1]] @ y[s[0] : s[1]].T >= threshold
            if same:
                hit &= np.arange(*r)[:, None] < np.arange(*s)[None, :]
            i, j = np.nonzero(hit)
            if len(i):
                yield i + r[0], j + s[0]
        else:
            todo += [(u, v) for u in halves(bx, r) for v in halves(by, s)]


#: An interval's vectors have the ids seq * 2**20 + place.
PLACE = 20


def node_links(intervals: DataFrame, pairs: DataFrame, counts: DataFrame, axes: np.ndarray, threshold: float, eps: float, leaf: int) -> DataFrame:
    """(x, y, n): n null for a link of a forest between nodes x and y, else node x links with n vectors of other nodes (summed over rows)."""
    dim = axes.shape[0]

    def run(batches):
        for batch in batches:
            for a, b, xa, xb, na, nb in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                same = a == b
                x = np.frombuffer(xa, np.float64).reshape(-1, dim)
                y = x if same else np.frombuffer(xb, np.float64).reshape(-1, dim)
                cx, cy = np.frombuffer(na, np.int64), np.frombuffer(nb, np.int64)
                lx, ly = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for i, j in _joined(x, y, same, threshold, eps, leaf, axes):
                    np.add.at(lx, i, cy[j])
                    np.add.at(ly, j, cx[i])
                    u, v = forest(np.concatenate([u, i + (a << PLACE)]), np.concatenate([v, j + (b << PLACE)]))
                sx, sy = np.flatnonzero(lx), np.flatnonzero(ly)
                first = np.concatenate([u, sx + (a << PLACE), sy + (b << PLACE)])
                second = pa.array(np.concatenate([v, np.zeros(len(sx) + len(sy), np.int64)]))
                n = pa.array(np.concatenate([np.zeros(len(u), np.int64), lx[sx], ly[sy]]), mask=np.arange(len(first)) < len(u))
                yield pa.RecordBatch.from_arrays([pa.array(first), second, n], names=["x", "y", "n"])

    data = intervals.join(counts, "seq").select("seq", "units", "counts")
    met = pairs.join(data.select(F.col("seq").alias("a"), F.col("units").alias("xa"), F.col("counts").alias("na")), "a")
    met = met.join(data.select(F.col("seq").alias("b"), F.col("units").alias("xb"), F.col("counts").alias("nb")), "b")
    return met.select("a", "b", "xa", "xb", "na", "nb").mapInArrow(run, "x long, y long, n long")


def near_embeddings(vectors: DataFrame, threshold: float = 0.95, lead: int = 16, interval: int = 8192, leaf: int = 128, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of ``vectors``."""
    size = F.coalesce(F.size(vec_col), F.lit(0))
    lengths = sorted(r["d"] for r in vectors.select(size.alias("d")).distinct().collect())
    alone = vectors.where(size < 1).select(F.col(id_col).alias("id"))
    out = alone.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for dim in lengths:
        if dim > 0:
            out = out.unionByName(_near(vectors.where(size == dim), dim, threshold, lead, interval, leaf, id_col, vec_col))
    return out


def _near(vectors: DataFrame, dim: int, threshold: float, lead: int, interval: int, leaf: int, id_col: str, vec_col: str) -> DataFrame:
    """The same for vectors of one length."""
    eps = math.sqrt(2 - 2 * threshold)
    units = written(unit_vectors(vectors, dim, id_col, vec_col), "units")
    lone = lambda x: x.select(x["id"].alias(id_col), F.lit(0).cast("long").alias("n_links"), x["id"].alias("component_id"), F.lit(True).alias("kept"))
    nodes = units.where("unit is not null").groupBy("unit").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "unit-nodes")
    if nodes.isEmpty():
        return lone(units)
    axes = principal_axes(nodes, dim)
    intervals = written(grid_sequence(nodes, axes, eps, lead, interval), "intervals")
    width = (intervals.agg(F.max("no")).first()[0] + 1).bit_length()
    intervals = intervals.withColumn("seq", F.shiftleft("part", width) + F.col("no")).select("seq", "low", "high", "units")
    places = written(intervals.select("seq", "units").mapInArrow(_places(dim), "node long, unit binary").join(nodes, "unit").select("node", "unit", "least", "copies"), "places")
    pairs = interval_pairs(intervals, eps)
    counts = places.groupBy(F.shiftright("node", PLACE).alias("seq")).agg(F.array_sort(F.collect_list(F.struct("node", "copies"))).alias("c"))
    counts = counts.select("seq", F.col("c.copies").alias("c")).mapInArrow(_packed, "seq long, counts binary")
    found = written(node_links(intervals, pairs, counts, axes, threshold, eps, leaf), "links")
    links = found.where("n is not null").groupBy(F.col("x").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("n is null").select(F.col("x").alias("a"), F.col("y").alias("b")))
    told = places.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    told = written(told.select("unit", "root", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    told = told.join(told.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("unit", "n_links", "component_id")
    out = units.join(told, "unit", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _places(dim: int):
    def run(batches):
        for batch in batches:
            for seq, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(units) // (8 * dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + (seq << PLACE)), pa.array([units[8 * dim * i : 8 * dim * (i + 1)] for i in range(n)], pa.binary())], names=["node", "unit"])

    return run


def _packed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(c, np.int64).tobytes() for c in batch.column(1).to_pylist()], pa.binary())], names=["seq", "counts"])
