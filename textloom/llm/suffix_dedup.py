"""Suffix-array dedup: a distributed difference-cover (DC3) suffix sort, then a comparison of adjacent prefixes.

Reduction, exact: of equal texts only the first is sorted (every byte of the
others is repeated, if they have ``length`` bytes at all). Winnowing marks one
anchor in every run of ``length`` bytes, by content alone, so equal runs share
their anchors. An anchor's context is all runs that hold it at its place; of
equal contexts, too, only the first counts (the others are repeated whole), and
one whose anchor has no other context then holds no repeated run. What is left
is sorted, in segments.

Sort: segments are packed into blocks, in the order of documents and starts.
Every block is a string of its own, so the recursion stays inside blocks and
only sorting is shared by the cluster:
 - windows of three symbols (of more, where they take no further key) at places 1
   and 2 mod 3 of all blocks are sorted by sampled splitters
   and named by rank; a block sends each window once, however often it has it;
   its names at 1 mod 3, then at 2 mod 3, are its string of the next level;
 - the recursion ends when names are unique or cover ``length`` bytes, beyond
   which an order is of no interest;
 - going back, the suffixes at 0 mod 3 are sorted by (symbol, rank of the next
   place) and merged with the others, whose ranks are known, by the comparisons
   of the algorithm, in one task for each range of the order. Ranges are cut at
   sampled suffixes, which are compared whole, so that no prefix, however
   frequent, makes a range large.
At the end each suffix has the one before it in the order: neighbours with the
same first ``length`` bytes (compared by a 64-bit hash; as only neighbours are
compared, n suffixes err with chance n / 2**64) are one run of the order, and
all of a run but its first place in the documents are repeats. A run may go on
over ranges: each range tells its first and last run, and these are joined.

Ranges, blocks and counts per range are all that tasks need to know of each
other; the driver sees ``SAMPLES`` splitters a block and three rows a range.

Defined results: a null text is empty; documents go by (id, text hash), null
ids first, and of rows alike in both one is the first; documents shorter than
``length`` bytes have no repeats; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import erase, written

#: Bytes of text in a block (of up to 16 GB of texts; it doubles with each four times as much, so that pieces of blocks in ranges don't
#: get too small; a range has half as much, and doubles from a GB on), in a task's group of texts while anchors are found, and places of a
#: block that are sampled.
BLOCK_BYTES, CHUNK_BYTES, SAMPLES = 1 << 20, 1 << 24, 64
#: Texts are searched for anchors so many bytes at a time, which fit in a processor's cache; longer ones in parts that overlap.
PART_BYTES = 1 << 14
GRAM = 50
#: Their working memory is kept from call to call, which costs more than many a small array.
_SQUEEZE, _SPREAD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the greatest needs (the first byte says how many), low bytes before high ones."""
    top = int(x.max(initial=0))
    size = next(k for k in (1, 2, 4, 8) if k == 8 or top < 1 << (8 * k))
    x = x.astype(f"<u{size}").view(np.uint8)
    if size > 1:
        x = np.concatenate([x[k::size] for k in range(size)])
    return bytes([size]) + _SQUEEZE.compress(x)


def _open(data: bytes) -> np.ndarray:
    size, x = data[0], np.frombuffer(_SPREAD.decompress(memoryview(data)[1:]), np.uint8)
    n = len(x) // size
    out = np.zeros((n, 8), np.uint8)
    for k in range(size):
        out[:, k] = x[k * n : (k + 1) * n]
    return out.view("<u8").ravel()


def _pack_rising(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=x.dtype.type(0)))


def _open_rising(data: bytes) -> np.ndarray:
    return np.cumsum(_open(data), dtype=np.uint64)


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = False
        for x in sorted_columns:
            new[1:] |= x[1:] != x[:-1]
    return new


# --- anchors ---------------------------------------------------------------------------------------------------------


def _joined(a: np.ndarray, shift: int, b: np.ndarray) -> np.ndarray:
    n = max(0, min(len(a), len(b) - shift))
    y = a[:n] * MIX
    y ^= b[shift : shift + n]
    y *= TURN
    y ^= y >> np.uint64(29)
    return y


def run_hashes(text: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length, a 64-bit hash of every run of so many symbols, by doubling."""
    powers, size = [text.astype(np.uint64) * np.uint64(3) + np.uint64(1)], 1
    while 2 * size <= max(lengths):
        powers.append(_joined(powers[-1], size, powers[-1]))
        size *= 2
    out = []
    for length in lengths:
        top = length.bit_length() - 1
        found, have = powers[top], 1 << top
        for k in range(top - 1, -1, -1):
            if have + (1 << k) <= length:
                found = _joined(found, have, powers[k])
                have += 1 << k
        out.append(found)
    return out


def _hashes_in_parts(s: np.ndarray, length: int) -> np.ndarray:
    """As :func:`run_hashes` of one length, a part at a time, as parts fit in a processor's cache."""
    found = [run_hashes(s[a : a + PART_BYTES + length - 1], length)[0] for a in range(0, max(1, len(s) - length + 1), PART_BYTES)]
    return np.concatenate(found)


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(texts: list[bytes], length: int) -> list[np.ndarray]:
    """(text number, place, anchor hash, context hash) of the grams of least hash in each run of ``length`` bytes.

    The context of an anchor at p is ``[p - (length - gram), p + length)``, as far as the text goes; its hash tells how far.
    """
    gram = min(GRAM, length)
    margin, width = length - gram, length - gram + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer(b"".join(texts), np.uint8)
    if len(x) < length:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
    ends = np.cumsum(sizes)
    h, whole = run_hashes(x, gram, margin + length)
    h = np.maximum(h, np.uint64(1))
    low = _extreme(h, width, np.minimum).copy()
    end_of = np.repeat(ends, sizes)
    low[np.arange(len(low)) + length > end_of[: len(low)]] = 0  # runs must not go on into the next text
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == _extreme(np.concatenate([pad, low, pad]), width, np.maximum)[: len(h)])
    of = np.searchsorted(ends, at, "right")
    starts = ends - sizes
    begin, end = at - margin, at + length
    cut = (begin < starts[of]) | (end > ends[of])
    context = np.empty(len(at), np.uint64)
    context[~cut] = whole[begin[~cut]]
    for k in np.flatnonzero(cut).tolist():
        d = int(of[k])
        s, a = int(starts[d]), int(at[k])
        context[k] = xxhash.xxh64_intdigest(texts[d][max(0, a - margin - s) : a + length - s], min(a - s, margin) + 1)
    return [of, at - starts[of], h[at], context]


def _text_anchors(rows: list[int], texts: list[bytes], length: int) -> list[np.ndarray]:
    """(row, place, anchor hash, context hash), rising by row and place; long texts go in parts that overlap."""
    parts, held, size, found = [], [], 0, []

    def go():
        of, place, h, c = anchors([t for _, _, t, _, _ in held], length)
        row, shift, _, least, most = (np.array(v, np.int64) if i != 2 else None for i, v in enumerate(zip(*held, strict=True)))
        place = place + shift[of]
        inside = (place >= least[of]) & (place < most[of])
        found.append([row[of][inside], place[inside], h[inside], c[inside]])
        held.clear()

    for row, text in zip(rows, texts, strict=True):
        n = len(text)
        if n <= PART_BYTES:
            parts = [(row, 0, text, 0, n)]
        else:  # anchors of a part's middle have all their runs and their whole context in it
            parts = [(row, a := max(0, s - 2 * length), text[a : s + PART_BYTES + 2 * length], s, s + PART_BYTES) for s in range(0, n, PART_BYTES)]
        for part in parts:
            held.append(part)
            size += len(part[2])
            if size > PART_BYTES:
                go()
                size = 0
    if held:
        go()
    return [np.concatenate([f[i] for f in found]) for i in range(4)]


def _send_anchors(length: int, n_buckets: int):
    """Texts (row, text) to packed anchors: each context once a chunk (by its first place) to its bucket, and the other places, which are repeats, to the chunk's own answer."""

    names = ["bucket", "chunk", "hashes", "contexts", "rows", "places"]

    def sent(chunk: int, rows: list, texts: list[bytes]):
        order = np.argsort(np.array(rows), kind="stable").tolist()
        row, place, h, c = _text_anchors([rows[i] for i in order], [texts[i] for i in order], length)
        by = np.argsort((h ^ (c >> np.uint64(7))) * MIX ^ c, kind="stable")
        by = by[np.lexsort((c[by], h[by]))] if len(by) and _mixed(h[by], c[by]) else by
        new = _heads(h[by], c[by])
        first, again = by[new], np.sort(by[~new])
        bucket = (h[first] % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((first, bucket))
        first, bucket = first[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
        pieces = [(b, first[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts)).tolist()]
        column = lambda make: pa.array([make(p) for _, p in pieces], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in pieces], pa.int64()), pa.array([chunk] * len(pieces), pa.int64()), column(lambda p: _pack(h[p])), column(lambda p: _pack(c[p])), column(lambda p: _pack_rising(row[p])), column(lambda p: _pack(place[p]))],
            names=names,
        )
        if len(again):
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([(chunk * 0x9E3779B1 >> 16) % n_buckets], pa.int64()), pa.array([chunk], pa.int64()), none, none, pa.array([_pack_rising(row[again])], pa.binary()), pa.array([_pack(place[again])], pa.binary())], names=names)

    def run(batches):
        chunk, rows, texts, size = TaskContext.get().partitionId() << 20, [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(row)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from sent(chunk, rows, texts)
                    chunk, rows, texts, size = chunk + 1, [], [], 0
        if rows:
            yield from sent(chunk, rows, texts)

    return run, "bucket long, chunk long, hashes binary, contexts binary, rows binary, places binary"


def _mixed(h: np.ndarray, c: np.ndarray) -> bool:
    """Whether rows sorted by a hash of (h, c) have unlike rows of one hash; a chance of some 2**-24 a chunk."""
    k = (h ^ (c >> np.uint64(7))) * MIX ^ c
    return bool(((k[1:] == k[:-1]) & ((h[1:] != h[:-1]) | (c[1:] != c[:-1]))).any())


def _groups(batches, n: int):
    """Rows in order of their first column, as (key, columns)."""
    now, held = None, []
    for batch in batches:
        for key, *row in zip(*(batch.column(i).to_pylist() for i in range(n + 1)), strict=True):
            if key != now:
                if held:
                    yield now, [list(c) for c in zip(*held, strict=True)]
                now, held = key, []
            held.append(row)
    if held:
        yield now, [list(c) for c in zip(*held, strict=True)]


def _classes(batches):
    """A bucket's anchors to (chunk, rows, places, sort): repeats (sort 0), and first places of contexts to sort (1)."""
    for _, (chunks, hashes, contexts, rows, places) in _groups(batches, 5):
        known = [i for i, h in enumerate(hashes) if h is not None]
        out = [(chunks[i], rows[i], places[i], _pack(np.zeros(len(_open(places[i])), np.uint64))) for i, h in enumerate(hashes) if h is None]
        if known:
            r, p = [_open_rising(rows[i]) for i in known], [_open(places[i]) for i in known]
            of = np.repeat(np.array(known), [len(x) for x in p])
            h, c = (np.concatenate([_open(x[i]) for i in known]) for x in (hashes, contexts))
            r, p = np.concatenate(r), np.concatenate(p)
            by = np.lexsort((p, r, c, h))
            own = _heads(h[by], c[by])
            anchor = np.cumsum(_heads(h[by])) - 1
            wanted = own & (np.bincount(anchor, own)[anchor] > 1)
            told = np.zeros(len(by), np.int8)
            told[by] = np.where(own, np.where(wanted, 2, 0), 1)
            some = np.flatnonzero(told)
            cuts = np.searchsorted(of[some], known + [len(hashes)]) if len(some) else [0] * (len(known) + 1)
            for i, a, b in zip(known, cuts, cuts[1:], strict=False):
                if b > a:
                    s = some[a:b]
                    out.append((chunks[i], _pack_rising(r[s]), _pack(p[s]), _pack(told[s] - 1)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=["chunk", "rows", "places", "sort"])


def _stretches(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged stretches of rows; those that touch are one."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    if not len(row):
        return row, begin, end
    first = np.flatnonzero(_heads(row))
    base = np.repeat(np.arange(len(first)) * (int(end.max()) + 2), np.diff(np.append(first, len(row))))
    far = np.maximum.accumulate(end + base)
    new = np.ones(len(row), bool)
    new[1:] = begin[1:] + base[1:] > far[:-1]
    at = np.flatnonzero(new)
    return row[at], begin[at], far[np.append(at[1:], len(row)) - 1] - base[at]


def _row_stretches(length: int):
    """A chunk's answers to (row, repeats, wanted): stretches as packed starts and ends, which may go beyond the text's end."""
    margin = length - min(GRAM, length)

    def run(batches):
        for _, (rows, places, sort) in _groups(batches, 3):
            r, p = np.concatenate([_open_rising(x) for x in rows]).astype(np.int64), np.concatenate([_open(x) for x in places]).astype(np.int64)
            kind = np.concatenate([_open(x) for x in sort])
            out: dict[int, list] = {}
            for k in (0, 1):
                some = kind == k
                row, begin, end = _stretches(r[some], np.maximum(p[some] - margin, 0), p[some] + length)
                first = np.flatnonzero(_heads(row))
                for i, a, b in zip(row[first].tolist(), first.tolist(), [*first[1:].tolist(), len(row)], strict=False):
                    out.setdefault(i, [None, None])[k] = np.stack([begin[a:b], end[a:b]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *(pa.array([v[k] for v in out.values()], pa.binary()) for k in (0, 1))], names=["row", "repeats", "wanted"])

    return run


def _segments(batches):
    """(row, text, wanted) to segments (row, start, bytes)."""
    for batch in batches:
        out = []
        for row, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            out += [(row, a, text[a:b]) for a, b in np.frombuffer(wanted, "<i8").reshape(2, -1).T.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["row", "start", "segment"])


def _blocks(block_bytes: int):
    """Sorted segments to blocks (block, rows, starts, sizes, symbols): each segment is followed by a zero, bytes count from one."""

    def made(block, held):
        text = np.concatenate([y for _, _, x in held for y in (np.frombuffer(x, np.uint8).astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16))])
        columns = [_pack_rising(np.array([r for r, _, _ in held], np.uint64)), *(_pack(np.array(c, np.uint64)) for c in ([s for _, s, _ in held], [len(x) for _, _, x in held])), _pack(text)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], names=["block", "rows", "starts", "sizes", "symbols"])

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append(row)
                size += len(row[2]) + 1
                if size >= block_bytes:
                    yield made(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield made(block, held)

    return run


# --- the sort --------------------------------------------------------------------------------------------------------


def _span(bits: int) -> int:
    """How many symbols a name covers: three, or more that take no further key."""
    return max(3, 64 // bits) if 3 * bits <= 64 else 4 if 2 * bits <= 64 else 3


def _windows(s: np.ndarray, at: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ``_span(bits)`` symbols from each of ``at`` on in as few keys as symbols of ``bits`` bits allow, the first key first."""
    span, n = _span(bits), np.uint64(bits)
    padded = np.concatenate([s, np.zeros(span, np.uint64)])
    each = span if 3 * bits <= 64 else 2 if 2 * bits <= 64 else 1
    keys = []
    for k in range(0, span, each):
        key = padded[at + k]
        for i in range(k + 1, k + each):
            key = key << n | padded[at + i]
        keys.append(key)
    return keys


def _ranks(x: np.ndarray) -> np.ndarray:
    """Of each value, how many lower ones there are."""
    order = np.argsort(x)
    out = np.empty(len(x), np.uint64)
    out[order] = np.cumsum(_heads(x[order])) - 1
    return out


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the first key, then the next; plain sorts of one key are some times as fast as a sort of several."""
    whole = keys[0]
    for key in keys[1:]:
        if (both := _one_key([whole, key])) is None:
            both = _one_key([_ranks(whole), _ranks(key)])
        whole = both[0]
    return np.argsort(whole)


def _distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the columns in order, and of each row which one it is."""
    order = _order(keys)
    new = _heads(*(k[order] for k in keys))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return [k[order[new]] for k in keys], which


def _bits(*arrays: np.ndarray) -> int:
    return max(int(x.max(initial=0)) for x in arrays).bit_length()


def _one_key(columns: list[np.ndarray], *more: list[np.ndarray]) -> list[np.ndarray] | None:
    """The columns of each list as one key, in the same order; None if that takes over 64 bits."""
    lists = [columns, *more]
    low = [min((int(x[i].min()) for x in lists if len(x[i])), default=0) for i in range(len(columns))]
    lists = [[c - np.uint64(a) for c, a in zip(x, low, strict=True)] for x in lists]
    widths = [_bits(*(x[i] for x in lists)) for i in range(len(columns))]
    if sum(widths) > 64:
        return None
    out = []
    for x in lists:
        key = x[0]
        for c, w in zip(x[1:], widths[1:], strict=True):
            key = (key << np.uint64(w) | c) if w < 64 else c
        out.append(key)
    return out


def _before(columns: list[np.ndarray], cuts: list[np.ndarray], side: str = "right") -> np.ndarray:
    """Of each row of ``columns``, how many of the (rising) rows of ``cuts`` are not above it (below it, for "left")."""
    if (keys := _one_key(columns, cuts)) is not None:
        return np.searchsorted(keys[1], keys[0], side)
    first, second = (cuts, columns) if side == "right" else (columns, cuts)
    order = np.lexsort([*[np.concatenate(c) for c in zip(first, second, strict=True)][::-1]])
    is_cut = (order < len(first[0])) == (side == "right")
    out = np.empty(len(columns[0]), np.int64)
    out[order[~is_cut] - (len(cuts[0]) if side == "right" else 0)] = np.cumsum(is_cut)[~is_cut]
    return out


def _before_rising(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """As :func:`_before`, of rising rows: each cut is looked up, not each row."""
    out = np.zeros(len(columns[0]) + 1, np.int64)
    for cut in zip(*cuts, strict=True):
        a, b = 0, len(columns[0])
        for column, value in zip(columns, cut, strict=True):
            first = a + int(np.searchsorted(column[a:b], value))
            a, b = first, a + int(np.searchsorted(column[a:b], value, "right"))
        out[a] += 1
    return np.cumsum(out[:-1])


def _sample(rows, n: int, pick):
    """``n`` of a block's places, seeded by its number, as rows of the arrays that ``pick(row, places)`` gives."""
    rng, size = np.random.default_rng(rows[0]), len(_open(rows[1]))
    return pick(rows, np.sort(rng.integers(0, max(1, size), n)))


class _Once:
    """A function of a block's row that remembers its last value."""

    def __init__(self, of) -> None:
        self.of, self.block, self.value = of, None, None

    def __call__(self, row):
        if row[0] != self.block:
            self.block, self.value = row[0], self.of(row)
        return self.value


def _splitters(level: DataFrame, n_parts: int, width: int, pick) -> tuple[list[np.ndarray], int]:
    """At most ``n_parts`` - 1 rows that cut the sampled places evenly, and the number of places at 1 and 2 mod 3 of the level."""
    names = [*(f"k{i}" for i in range(width)), "n"]

    def some(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, size = _sample(row, SAMPLES, pick), len(_open(row[1]))
                n = np.zeros(len(keys[0]) + 1, np.int64)
                n[-1] = size - -(-size // 3)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.append(k, np.uint64(0)).view(np.int64)) for k in keys), pa.array(n)], names=names)

    found = level.mapInArrow(some, ", ".join(f"{c} long" for c in names)).toArrow()
    n, own = int(found["n"].to_numpy().sum()), found["n"].to_numpy() == 0
    keys = [found[c].to_numpy()[own].view(np.uint64) for c in names[:-1]]
    if not len(keys[0]):
        return keys, n
    order = np.lexsort(keys[::-1])
    at = order[np.linspace(0, len(order) - 1, n_parts + 1).astype(int)[1:-1]]
    keys = [k[at] for k in keys]
    new = _heads(*keys)
    return [k[new] for k in keys], n


class _Exchange:
    """Sends each block's rows to ranges of the order, and what a range finds for them back to the block.

    ``parts(row)`` gives the range of each place sent, also when answers are put in place, so that no places travel;
    ``send(row)`` their arrays and how to pack them; ``receive(packed, blocks)`` a value for each, sizes, how many values the range has, and more to tell.
    """

    def __init__(self, n_parts: int, parts, send, receive, columns: int) -> None:
        self.n_parts, self.parts, self.send, self.receive, self.columns = n_parts, parts, send, receive, columns

    @staticmethod
    def cut(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(part.astype(np.int16) if part.max(initial=0) < 1 << 15 else part, kind="stable")
        parts, first = np.unique(part[order], return_index=True)
        return order, parts, first

    def ranges(self, level: DataFrame) -> DataFrame:
        """(block, part, found, n, extra), written."""
        columns, part_of, send, receive, cut = self.columns, self.parts, self.send, self.receive, self.cut
        names = ["part", "block", *(f"c{i}" for i in range(columns))]

        def out(batches):
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    order, parts, first = cut(part_of(row))
                    arrays, pack = send(row)
                    packed = [pack([v[o] for v in arrays]) for o in np.split(order, first[1:])] if len(parts) else []
                    yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), pa.array([row[0]] * len(parts), pa.int64()), *(pa.array([p[i] for p in packed], pa.binary()) for i in range(columns))], names=names)

        def back(batches):
            for part, (blocks, *packed) in _groups(batches, columns + 1):
                values, sizes, n, extra = receive(packed, np.array(blocks))
                found = [_pack(v) for v in np.split(values, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([part] * len(blocks), pa.int64()), pa.array(found, pa.binary()), pa.array([n] + [0] * (len(blocks) - 1), pa.int64()), pa.array([extra] + [None] * (len(blocks) - 1), pa.binary())], names=["block", "part", "found", "n", "extra"])

        sent = level.mapInArrow(out, "part long, block long" + "".join(f", c{i} binary" for i in range(columns)))
        sent = sent.repartition(self.n_parts, "part").sortWithinPartitions("part", "block")
        return written(sent.mapInArrow(back, "block long, part long, found binary, n long, extra binary"), "suffix-ranges", "none")

    def back(self, found: DataFrame, level: DataFrame, answer, fields: str, names: list[str]) -> DataFrame:
        """``answer(row, values)`` for each block, with the values in the order of ``send``'s rows; both sides have one row or few a block."""
        part_of, cut, width = self.parts, self.cut, len(level.columns)
        none = [F.lit(None).cast(t).alias(c) for c, t in level.dtypes if c != "block"]
        mine = found.select("block", "part", "found", *none)
        theirs = level.select("block", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("found"), *[c for c in level.columns if c != "block"])

        def run(batches):
            for block, (parts, values, *rest) in _groups(batches, width + 1):
                row = (block, *(c[0] for c in rest))
                order, _, _ = cut(part_of(row))
                out = np.zeros(len(order), np.uint64)
                if len(order):
                    out[order] = np.concatenate([_open(v) + np.uint64(add) for v, add in zip(values[1:], self.below(parts[1:]), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in answer(row, out))], names=names)

        return mine.unionByName(theirs).repartition(self.n_parts, "block").sortWithinPartitions("block", "part").mapInArrow(run, fields)

    starts: dict[int, int] | None = None

    def below(self, parts: list[int]) -> list[int]:
        return [self.starts[p] if self.starts else 0 for p in parts]

    def count(self, found: DataFrame) -> int:
        """The number of values in all ranges; from now on answers count from one over all of them."""
        counts = {r["part"]: r["n"] for r in found.where("n > 0").select("part", "n").collect()}
        self.starts, total = {}, 0
        for part in sorted(counts):
            self.starts[part], total = total + 1, total + counts[part]
        return total


class _Names(_Exchange):
    """Names of the windows (of three symbols or more) at 1 and 2 mod 3: their ranks."""

    def __init__(self, level: DataFrame, n_parts: int, bits: int) -> None:
        width = len(_windows(np.zeros(1, np.uint64), np.zeros(1, np.int64), bits))

        def keys(row):
            s = _open(row[1])
            return _distinct(_windows(s, np.flatnonzero(np.arange(len(s)) % 3), bits))

        keys = _Once(keys)
        cuts, self.n_places = _splitters(level, n_parts, width, lambda row, at: _windows(_open(row[1]), at, bits))

        def pack(arrays):
            return [_pack_rising(arrays[0]), *map(_pack, arrays[1:])]

        def parts(row):
            return _before_rising(keys(row)[0], cuts)

        def send(row):
            return keys(row)[0], pack

        def receive(packed, blocks):
            arrays = [[(_open_rising if i == 0 else _open)(x) for x in c] for i, c in enumerate(packed)]
            own, which = _distinct([np.concatenate(a) for a in arrays])
            return which.astype(np.uint64), [len(x) for x in arrays[0]], len(own[0]), None

        super().__init__(n_parts, parts, send, receive, width)
        self.keys = keys

    def named(self, found: DataFrame, level: DataFrame) -> DataFrame:
        """(block, symbols, names by place: zero at 0 mod 3)."""
        keys = self.keys

        def answer(row, names):
            s = _open(row[1])
            values = np.zeros(len(s), np.uint64)
            values[np.arange(len(s)) % 3 > 0] = names[keys(row)[1]]
            return row[1], _pack(values)

        return written(self.back(found, level, answer, "block long, symbols binary, values binary", ["block", "symbols", "values"]), "suffix-named", "none")


def merge_order(kind, a, b, own, one, two) -> np.ndarray:
    """Place in the order of each suffix, from zero: those at 0 mod 3 merged with the others."""
    zero = np.flatnonzero(kind == 0)
    others = np.flatnonzero(kind != 0)
    others = others[np.argsort(own[others])]
    key = _one_key([a[zero], one[zero]])
    zero = zero[np.lexsort((one[zero], a[zero])) if key is None else np.argsort(key[0])]
    # Suffixes of one class in order of rank are in order of the keys that suffixes at 0 mod 3 are compared with them by.
    k1, k2 = others[kind[others] == 1], others[kind[others] == 2]
    before = sum(_before([k[zero] for k in keys], [k[group] for k in keys], "left") for group, keys in ((k1, [a, one]), (k2, [a, b, two])))
    at = np.empty(len(kind), np.uint64)
    # ``before`` ascends with zero's order up to ties beyond the sorted depth; made monotone so that places are distinct.
    before = np.maximum.accumulate(before) if len(zero) else before
    at[zero] = np.arange(len(zero)) + before
    rest = np.arange(len(others)) + np.searchsorted(before, np.arange(len(others)), "right")
    at[others] = rest
    return at


class _Merge(_Exchange):
    """Order of all suffixes, from (block, symbols, ranks at 1 and 2 mod 3); with ``length``, which of them repeat."""

    WIDTH = 7

    def __init__(self, ranked: DataFrame, n_parts: int, length: int = 0) -> None:
        def known(row):
            s, r = _open(row[1]), _open(row[2])
            r = np.concatenate([r, np.zeros(len(s) + 3 - len(r), np.uint64)])
            return np.concatenate([s, np.zeros(3, np.uint64)]), r

        def pick(row, at):
            """Of suffixes at 1 mod 3: own rank, symbol, rank of the next place."""
            s, r = known(row)
            at = at // 3 * 3 + 1
            at = at[at < len(s) - 3]
            return r[at], s[at], r[at + 1]

        cuts, _ = _splitters(ranked.select("block", "symbols", "values"), n_parts, 3, pick)
        new = _heads(cuts[0])  # ranks tie where they are equal for long enough
        cuts = [c[new] for c in cuts]

        def rows(row):
            """Which places are sent, in order, and for the last order the hash of each one's prefix."""
            s = _open(row[1])
            if not length:
                return np.arange(len(s)), None
            sizes = _open(row[3]).astype(np.int64)
            h = _hashes_in_parts(s, length)
            left = np.concatenate([np.arange(n, -1, -1) for n in sizes.tolist()])
            at = np.flatnonzero(left >= length)
            # Of places with one prefix the first is sent: the others are repeats.
            order = np.argsort(h[at])
            if len(at):
                at = at[np.sort(np.minimum.reduceat(order, np.flatnonzero(_heads(h[at][order]))))]
            return at, h[at]

        rows = _Once(rows)

        def pack(arrays):
            """Ranks that are unknown, or needed for no comparison, are left out."""
            kind, a, b, own, one, two, *more = arrays
            return [_pack(kind), _pack(a), _pack(b[kind != 1]), _pack(own[kind > 0]), _pack(one[kind < 2]), _pack(two[kind != 1]), _pack(more[0]) if more else b""]

        def parts(row):
            at, _ = rows(row)
            s, r = known(row)
            part = np.empty(len(at), np.int64)
            zero = at % 3 == 0
            part[~zero] = np.searchsorted(cuts[0], r[at[~zero]], "right")
            part[zero] = _before([s[at[zero]], r[at[zero] + 1]], cuts[1:]) if len(cuts[0]) else 0
            return part

        def send(row):
            at, h = rows(row)
            s, r = known(row)
            return [(at % 3).astype(np.uint64), s[at], s[at + 1], r[at], r[at + 1], r[at + 2], *([h] if length else [])], pack

        def opened(packed):
            kind = [_open(x) for x in packed[0]]
            sizes = [len(x) for x in kind]
            kind = np.concatenate(kind)

            def spread(column, some):
                out = np.zeros(len(kind), np.uint64)
                out[some] = np.concatenate([_open(x) for x in column])
                return out

            every = np.ones(len(kind), bool)
            masks = [every, kind != 1, kind > 0, kind < 2, kind != 1]
            return sizes, kind, [spread(c, m) for c, m in zip(packed[1:6], masks, strict=True)]

        def order_in(packed, blocks):
            sizes, kind, arrays = opened(packed)
            return merge_order(kind, *arrays), sizes, len(kind), None

        def repeats_in(packed, blocks):
            """A value of one for each suffix whose prefix occurs at an earlier place; rows come in the order of blocks and places."""
            sizes, kind, arrays = opened(packed)
            h = np.concatenate([_open(x) for x in packed[6]])
            order = np.empty(len(h), np.int64)
            order[merge_order(kind, *arrays).astype(np.int64)] = np.arange(len(h))
            new = _heads(h[order])
            run = np.cumsum(new) - 1
            first = np.minimum.reduceat(order, np.flatnonzero(new))
            repeat = np.ones(len(h), np.uint64)
            repeat[first] = 0
            of, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            tell = lambda k: [int(blocks[of[first[k]]]), int(first[k] - begin[of[first[k]]])]
            ends = [*tell(0), *tell(-1), int(h[order[0]]), int(h[order[-1]]), int(run[-1] + 1)]
            return repeat, sizes, len(h), np.array([x if x < 1 << 63 else x - (1 << 64) for x in ends], np.int64).tobytes()

        super().__init__(n_parts, parts, send, repeats_in if length else order_in, self.WIDTH)
        self.rows = rows

    def carried(self, found: DataFrame) -> dict[int, dict[int, list[int]]]:
        """Runs that go on over ranges: block to part to the answers (by number) that are repeats after all."""
        ends = sorted((r["part"], np.frombuffer(r["extra"], np.int64).tolist()) for r in found.where("extra is not null").select("part", "extra").collect())
        late: dict[int, dict[int, list[int]]] = {}
        best, last = None, None  # the first place so far, as (block, part, answer), of the run that ends the range before
        for part, (b0, k0, b1, k1, h0, h1, runs) in ends:
            opening, closing = (b0, part, k0), (b1, part, k1)
            if last is not None and last == h0:
                # Ranges of one block's suffixes do not go by place: places are compared by the blocks that hold them.
                kept, lost = self.earlier(best, opening)
                late.setdefault(lost[0], {}).setdefault(lost[1], []).append(lost[2])
                opening = kept
            best, last = (opening if runs == 1 else closing), h1
        return late

    @staticmethod
    def earlier(x, y):
        """Places with one prefix are in different blocks, as a block sends each prefix once."""
        return (x, y) if x[0] < y[0] else (y, x)


def _next_level(batches):
    """Names at 1 mod 3, a zero, names at 2 mod 3."""
    for batch in batches:
        rows = [_open(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_pack(np.concatenate([v[1::3], np.zeros(1, np.uint64), v[2::3]])) for v in rows], pa.binary())], names=["block", "symbols"])


def _level_ranks(symbols: bytes, ranks: np.ndarray) -> bytes:
    """Ranks of the next level's suffixes, put at the places they stand for."""
    values = np.zeros(len(_open(symbols)), np.uint64)
    ones = len(values[1::3])
    values[1::3], values[2::3] = ranks[:ones], ranks[ones + 1 : ones + 1 + len(values[2::3])]
    return _pack(values)


def _ranked(batches):
    for batch in batches:
        out = [_level_ranks(s, _open(r)) for s, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "symbols", "values"])


def sample_ranks(level: DataFrame, n_parts: int, bits: int, stride: int, covered: int, length: int) -> DataFrame:
    """(block, symbols, values): ranks at 1 and 2 mod 3 of ``level(block, symbols)``: their names, or, where these do not tell, the ranks of the next level.

    A symbol tells ``covered`` bytes from its place on, and the next one is ``stride`` bytes further.
    """
    covered += (_span(bits) - 1) * stride
    names = _Names(level, n_parts, bits)
    found = names.ranges(level)
    n_names = names.count(found)
    named = names.named(found, level)
    erase(found)
    if n_names == names.n_places or covered >= length:
        return named
    following = written(named.select("block", "values").mapInArrow(_next_level, "block long, symbols binary"), "suffix-level", "none")
    erase(named)
    below = sample_ranks(following, n_parts, max(1, n_names.bit_length()), 3 * stride, covered, length)
    erase(following)
    merge = _Merge(below, n_parts)
    found = merge.ranges(below)
    merge.count(found)
    ranks = written(merge.back(found, below, lambda row, values: [_pack(values)], "block long, ranks binary", ["block", "ranks"]), "suffix-ranks", "none")
    out = written(level.select("block", "symbols").join(ranks, "block").select("block", "symbols", "ranks").mapInArrow(_ranked, "block long, symbols binary, values binary"), "suffix-ranked", "none")
    for table in (found, below, ranks):
        erase(table)
    return out


def _covered(length: int, merge: _Merge, late: dict[int, dict[int, list[int]]]):
    """A block's answers to removed stretches: packed rows, starts and ends."""

    def answer(row, values):
        at, _ = merge.rows(row)
        if row[0] in late:
            part = merge.parts(row)
            order, _, _ = merge.cut(part)
            for p, lost in late[row[0]].items():
                values[order[part[order] == p][lost]] = 1
        sizes, r, s = _open(row[3]).astype(np.int64), _open_rising(row[4]).astype(np.int64), _open(row[5]).astype(np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        left = np.concatenate([np.arange(n, -1, -1) for n in sizes.tolist()])
        sent = np.zeros(len(left), bool)
        sent[at] = True
        hits = np.sort(np.concatenate([np.flatnonzero((left >= length) & ~sent), at[values == 1]]))
        seg = np.searchsorted(begin, hits, "right") - 1
        place = hits - begin[seg] + s[seg]
        row_, a, b = _stretches(r[seg], place, place + length)
        return _pack_rising(row_.astype(np.uint64)), _pack(a), _pack(b)

    return answer


def _listed(batches):
    for batch in batches:
        r, a, b = ([(_open_rising if i == 0 else _open)(x) for x in batch.column(1 + i).to_pylist()] for i in range(3))
        r, a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (r, a, b))
        first = np.flatnonzero(_heads(r)) if len(r) else np.zeros(0, np.int64)
        ends = [*first[1:].tolist(), len(r)]
        yield pa.RecordBatch.from_arrays([pa.array(r[first]), pa.array([np.stack([a[i:j], b[i:j]]).astype("<i8").tobytes() for i, j in zip(first.tolist(), ends, strict=False)], pa.binary())], names=["row", "stretches"])


def repeated_stretches(texts: DataFrame, length: int, n_bytes: int) -> DataFrame:
    """(row, stretches): packed starts and ends, in several rows for one text, of the bytes of ``texts(row, text binary)`` that repeated runs cover. Rows in order are documents in order."""
    n_buckets = max(8, n_bytes >> 25)
    run, fields = _send_anchors(length, n_buckets)
    hits = texts.select("row", "text").mapInArrow(run, fields).repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    hits = hits.mapInArrow(_classes, "chunk long, rows binary, places binary, sort binary").repartition(n_buckets, "chunk").sortWithinPartitions("chunk")
    hits = written(hits.mapInArrow(_row_stretches(length), "row long, repeats binary, wanted binary"), "suffix-hits")
    repeats = hits.where("repeats is not null").select("row", F.col("repeats").alias("stretches"))
    segments = texts.join(hits.where("wanted is not null").select("row", "wanted"), "row").select("row", "text", "wanted").mapInArrow(_segments, "row long, start long, segment binary")
    segments = segments.repartitionByRange(max(1, n_bytes >> 24), "row", "start").sortWithinPartitions("row", "start")
    block_bytes = BLOCK_BYTES << (max(0, n_bytes.bit_length() - 34) // 2)
    range_bytes = max(1, BLOCK_BYTES // 2) << (max(0, n_bytes.bit_length() - 30) // 2)
    blocks = written(segments.mapInArrow(_blocks(block_bytes), "block long, rows binary, starts binary, sizes binary, symbols binary"), "suffix-text", "none")
    n_blocks = blocks.count()
    if not n_blocks:
        return repeats
    n_parts = max(4, -(-n_blocks * block_bytes // range_bytes))
    level = blocks.select("block", "symbols")
    ranked = sample_ranks(level, n_parts, 9, 1, 1, length)
    ready = written(ranked.join(blocks.select("block", "sizes", "rows", "starts"), "block").select("block", "symbols", "values", "sizes", "rows", "starts"), "suffix-ready", "none")
    erase(ranked)
    erase(blocks)
    merge = _Merge(ready, n_parts, length)
    found = merge.ranges(ready)
    told = merge.back(found, ready, _covered(length, merge, merge.carried(found)), "block long, rows binary, starts binary, ends binary", ["block", "rows", "starts", "ends"])
    told = written(told.mapInArrow(_listed, "row long, stretches binary"), "suffix-stretches")
    erase(found)
    erase(ready)
    return repeats.unionByName(told)


# --- documents -------------------------------------------------------------------------------------------------------


def _cut_out(batches):
    """(row, text, packed stretches) to what is left of each text."""
    for batch in batches:
        out = []
        for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            both = np.concatenate([np.frombuffer(x, "<i8").reshape(2, -1) for x in packed or []] or [np.zeros((2, 0), np.int64)], axis=1)
            _, a, b = _stretches(np.zeros(both.shape[1], np.int64), both[0], np.minimum(both[1], len(text)))
            kept, at = hashlib.sha256(), 0
            merged = list(zip(a.tolist(), b.tolist(), strict=True))
            for s, e in merged:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            out.append((len(text), int((b - a).sum()), len(merged), kept.hexdigest(), [{"start": s, "end": e} for s, e in merged]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def dedup_runs(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed): one row per row of ``docs``; ``removed`` lists stretches of bytes."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n"))
    firsts = rows.where(F.col("n") >= length).groupBy("digest").agg(F.min(F.struct(F.col("id").isNotNull().alias("z"), F.col("id").alias("i"))).alias("f"), F.max("n").alias("n"))
    # Documents in order: a number that ascends with the first document of each text.
    order = firsts.select("digest", "n", "f").repartitionByRange(F.col("f"), F.col("digest")).sortWithinPartitions("f", "digest")
    order = written(order.select("digest", "n", F.col("f.i").alias("first"), F.monotonically_increasing_id().alias("row")), "suffix-order")
    n_bytes = order.agg(F.sum("n")).first()[0] or 0
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    if not n_bytes:
        return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("digest").alias("kept_sha256"), nothing.alias("removed"))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    # By id as well, so that copies, which may be a third of all rows, are dealt over all tasks; of rows alike in both, one.
    firsts = order.select("row", F.col("digest").alias("of"), "first")
    keyed = keyed.join(firsts, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")))
    keyed = keyed.withColumn("no", F.row_number().over(Window.partitionBy("digest", "id").orderBy("row"))).where("no = 1")
    texts = written(keyed.select("row", "text"), "suffix-texts")
    by = repeated_stretches(texts, length, n_bytes).groupBy("row").agg(F.collect_list("stretches").alias("x"))
    left = texts.join(by, "row", "left").select("row", "text", "x")
    told = written(left.mapInArrow(_cut_out, "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>"), "suffix-told")
    erase(texts)
    # Of rows with one text the first has what was found for it; the others, those alike in id and text included, go whole.
    told = told.join(order.select("row", "digest", "first"), "row").drop("row")
    alike = rows.groupBy("id", "digest", "n").count()
    met = alike.join(told, "digest", "left").withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), "count")))
    copy = F.col("n_bytes").isNotNull() & (~F.col("id").eqNullSafe(F.col("first")) | (F.col("no") > 1))
    pick = lambda whole, own, short: F.when(copy, whole).when(F.col("n_bytes").isNotNull(), own).otherwise(short)
    return met.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        pick(F.col("n"), F.col("n_removed"), zero).alias("n_removed"),
        pick(one, F.col("n_spans"), zero).alias("n_spans"),
        pick(F.sha2(F.lit(b""), 256), F.col("kept_sha256"), F.col("digest")).alias("kept_sha256"),
        pick(F.array(F.struct(zero.alias("start"), F.col("n").alias("end"))), F.col("removed"), nothing).alias("removed"),
    )
