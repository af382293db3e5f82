"""Byte-level BPE: ranked merges folded over byte arrays of distinct words by Spark higher-order functions.

First a cache is made: pieces (matches of the pattern) that are frequent in some
documents, ``max_frequent`` of at most ``FREQUENT_BYTES`` bytes at any size, are
folded and broadcast. What it holds, and which documents it was made from, spares
later folds and has no effect on any result. Then each partition's documents, all
and whole, pass through one stage, without a shuffle: a first pass numbers the
pieces as it meets them and sends each document as piece numbers; ahead of it go
the pieces that are new to the partition, those that are neither tokens nor
frequent as arrays of byte ids. Spark folds the merges over each such array; a
last pass puts the documents' ids together from the pieces' ids, and decodes them
by concatenating each id's bytes. Both passes forget pieces at the same marker
rows, so memory is bounded whatever a partition holds.

The rank map is a literal: Spark finds a key of a map value by a linear scan, so
the map from a pair of ids to the rank of their merge is laid out as two arrays
with one slot a key in either (cuckoo hashing), and a lookup reads two elements.

Results are written in the shared folder, and what was broadcast for them is
destroyed; settings of the session that the job needs are as before afterwards.

Defined results: a null text is empty (no ids); pieces of more than
``max_fold`` bytes, for which a fold takes quadratic time, are merged by the
same ranks with a heap instead; rows with null or repeated ids are rows like
others; an empty table gives an empty result; further columns are ignored, and
may have any name.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import erase, lean, written

NO_RANK = 1 << 16
#: White space as in the Unicode property; Python's own \s has four control characters more.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: base64 of the bytes, and the rank, which is also the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id * 2**16 + right id: the rank of what both make, for every cut of every token into two tokens."""
    found = {}
    for whole, rank in ranks.items():
        for cut in range(1, len(whole)):
            left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
            if left is not None and right is not None:
                found[left << 16 | right] = rank
    return found


class PairTable:
    """Two arrays of key * 2**16 + rank; a key is in its slot of either one."""

    def __init__(self, pairs: dict[int, int]) -> None:
        self.bits = max(4, (len(pairs) - 1).bit_length())
        seed = 0
        while not self._fill(pairs, np.random.default_rng(seed)):
            seed += 1
            self.bits += seed % 4 == 0

    def _fill(self, pairs: dict[int, int], rng) -> bool:
        # Keys have 32 bits and multipliers 30, so that products stay below 2**63.
        self.factors = [int(x) | 1 for x in rng.integers(1 << 29, 1 << 30, 2)]
        self.rows = [[-1] * (1 << self.bits) for _ in range(2)]
        for key, rank in pairs.items():
            packed, side = key << 16 | rank, 0
            for _ in range(500):
                at = self.slot(packed >> 16, side)
                packed, self.rows[side][at] = self.rows[side][at], packed
                if packed < 0:
                    break
                side = 1 - side
            else:
                return False
        self.texts = [json.dumps(row, separators=(",", ":")) for row in self.rows]
        del self.rows
        return True

    def slot(self, key: int, side: int) -> int:
        return (key * self.factors[side] >> 26) & ((1 << self.bits) - 1)

    def bound(self, body) -> Column:
        """``body(arrays)`` with both arrays as variables: where a plan or its text has a literal, each copy takes megabytes of the driver."""
        first, second = (F.from_json(F.lit(text), "array<bigint>") for text in self.texts)
        return _let(first, lambda a: _let(second, lambda b: body([a, b])))

    def ranked(self, elements: Column, arrays: list[Column]) -> Column:
        """Elements key * 2**28 + rest become rank * 2**28 + rest; the rank is NO_RANK where a key has none."""

        def one(x: Column) -> Column:
            key = F.shiftright(x, 28)
            found = [F.get(t, F.shiftright(key * f, 26).bitwiseAND((1 << self.bits) - 1).cast("int")) for t, f in zip(arrays, self.factors, strict=True)]
            rest = x.bitwiseAND((1 << 28) - 1)
            hit = [(F.shiftright(v, 16) == key, F.shiftleft(v.bitwiseAND(65535), 28) + rest) for v in found]
            return F.when(*hit[0]).when(*hit[1]).otherwise(rest + (NO_RANK << 28))

        return F.transform(elements, one)


@cache
def _pair_table(ranks: tuple[tuple[bytes, int], ...]) -> PairTable:
    return PairTable(pair_ranks(dict(ranks)))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def fold_merges(word: Column, table: PairTable) -> Column:
    """Ids of a word, given as an array of its bytes' ids (int): while two neighbours have a rank, the leftmost of lowest rank merges.

    A token is rank * 2**28 + start * 2**16 + id: the rank of its merge with the
    next one (NO_RANK if none), the byte it starts at, and its id. The least
    element is thus the merge to make, and its rank is the id that it makes.
    Step 1 looks the ranks of all tokens up. A merge writes the merged token and
    looks up two ranks, its own and that of the token before; the rank map stands
    in the plan once, as the driver keeps the text of plans.
    """
    n = F.size(word)
    ident = lambda x: x.bitwiseAND(65535)
    stem = lambda x: x.bitwiseAND((1 << 28) - 1)
    keyed = lambda x, left, right: F.shiftleft(left * 65536 + right, 28) + x
    last = lambda x: x + (((1 << 32) - 1) << 28)  # noqa: E731  a key that no pair has

    def step(arrays: list[Column], s: Column, i: Column, least: Column, p: Column) -> Column:
        size, opening = F.size(s), i == 1
        every = F.transform(F.sequence(F.lit(0), size - 2), lambda k: keyed(F.get(s, k), ident(F.get(s, k)), ident(F.get(s, k + 1))))
        made = F.shiftright(least, 28)
        start = stem(least) - ident(least) + made
        new = F.when(p + 1 < size, keyed(start, made, ident(F.get(s, p + 1)))).otherwise(last(start))
        before = F.get(s, p - 2)
        near = F.when(p > 1, F.array(keyed(stem(before), ident(before), made), new)).otherwise(F.array(new))
        found = table.ranked(F.when(opening, every).otherwise(near), arrays)
        none = F.array().cast("array<bigint>")
        left = F.when(opening, none).otherwise(F.slice(s, F.lit(1), F.greatest(p - 2, F.lit(0))))
        right = F.when(opening, F.array(F.get(s, size - 1) + (NO_RANK << 28))).otherwise(F.slice(s, p + 2, n))
        return F.concat(left, found, right)

    def next_state(arrays: list[Column], s: Column, i: Column) -> Column:
        return _let(F.array_min(s), lambda m: F.when((i == 1) | (m < NO_RANK << 28), _let(F.array_position(s, m).cast("int"), lambda p: step(arrays, s, i, m, p))).otherwise(s))

    tokens = F.transform(word, lambda x, k: F.shiftleft(k.cast("bigint"), 16) + x)
    ids = lambda s: F.transform(s, lambda x: ident(x).cast("int"))
    return F.when(n < 2, word).otherwise(table.bound(lambda arrays: F.aggregate(F.sequence(F.lit(1), n), tokens, lambda s, i: next_state(arrays, s, i), ids)))


def merge_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps, for very long pieces."""
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = list(range(1, n + 1))
    rank = lambda i: ranks.get(piece[i : end[after[i]]]) if after[i] < n else None
    heap = [(r, i, end[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != to:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


@cache
def _plain_classes() -> dict[str, str]:
    """Letters and numbers below 2**16, as `regex` has them, as ranges for `re`, which looks them up in a table."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 1 << 16)]))
    runs = {k: [(m.start(), m.end() - 1) for m in regex.finditer(rf"\p{{{k}}}+", every)] for k in "LN"}
    return {k: "".join(f"\\u{ord(every[a]):04x}-\\u{ord(every[b]):04x}" for a, b in v) for k, v in runs.items()}


def _finder(pattern: str):
    """All matches in a text; by `re`, which takes half the time, where the pattern has no other properties than letters and numbers and the text nothing beyond 2**16."""
    own = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    slow, plain = regex.compile(own).findall, own
    for k, ranges in _plain_classes().items():
        inside = rf"(\[[^\]]*)\\p\{{{k}\}}"
        while re.search(inside, plain):
            plain = re.sub(inside, lambda m: m[1] + ranges, plain)  # noqa: B023
        plain = plain.replace(rf"\p{{{k}}}", f"[{ranges}]")
    if re.search(r"\\[pPNX]|\(\?[a-zA-Z<]|\[\[", plain):
        return slow
    fast, beyond = re.compile(plain).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: fast(text) if text.isascii() or not beyond(text) else slow(text)


#: What a partition's passes remember is forgotten after so many distinct pieces.
FORGET = 1 << 18
#: Documents that a pass handles at a time, so that few texts are in memory twice.
SLICE = 256
#: Ids that are spelled at a time.
AT_ONCE = 1 << 18
#: The share of documents that the cache is made from.
CACHE_SHARE = 0.125
#: Frequent pieces have no more bytes than this.
FREQUENT_BYTES = 64
#: While a job runs: the driver keeps the text of each plan, and that of these would hold the rank map several times over;
#: each task has two Python workers, and whole batches of texts stand in both and in Spark.
DURING = {"spark.sql.maxPlanStringLength": str(1 << 16), "spark.sql.execution.arrow.maxRecordsPerBatch": str(1 << 11)}


def _byte_ids(pieces: list[bytes], ranks: dict[bytes, int]) -> pa.ListArray:
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(single[np.frombuffer(b"".join(pieces), np.uint8)]))


def frequent_pieces(rows: DataFrame, shared, pattern: str, table: PairTable, max_frequent: int) -> _Frequent:
    """The most frequent pieces in ``_text`` that are no tokens themselves, with their ids: those as frequent as can all be taken.

    ``CACHE_SHARE`` of the documents tell well enough which pieces are frequent.
    """

    def count(batches):
        known, find = shared.value, _finder(pattern)

        def counted(chunks):
            found, alike = Counter(), defaultdict(list)
            for chunk, n in chunks.items():
                alike[n].append(chunk)
            for n, some in alike.items():
                for piece, m in Counter(find(" " + " ".join(some))).items():
                    found[piece] += n * m
            words = [(b, n) for x, n in found.items() if len(b := x.encode()) <= FREQUENT_BYTES and b not in known]
            for at in range(0, len(words), 1 << 14):
                part = words[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["piece", "n"])

        chunks: Counter = Counter()
        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                chunks.update(text.split(" "))
            if len(chunks) > 2 * FORGET:
                yield from counted(chunks)
                chunks.clear()
        yield from counted(chunks)

    def as_ids(batches):
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), _byte_ids(pieces, shared.value)], names=["piece", "word"])

    counts = rows.select("_text").sample(CACHE_SHARE, seed=1).mapInArrow(lean(count), "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = written(counts, "bpe-counts", during=DURING)
    # How many pieces have each count tells the least count to take, so that no task sorts or holds all of them.
    least, taken = 1 << 62, 0
    level = F.when(F.col("n") > 1000, 1000 + F.floor(F.log2("n"))).otherwise(F.col("n"))
    for r in sorted(counts.groupBy(level.alias("n")).count().collect(), key=lambda r: -r["n"]):
        taken += r["count"]
        if taken > max_frequent:
            break
        least = r["n"]
    top = counts.where(level >= least).select("piece").repartition(rows.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(as_ids, "piece binary, word array<int>")
    folded = written(top.select("piece", fold_merges(F.col("word"), table).alias("ids")), "bpe-frequent", during=DURING).toArrow().combine_chunks()
    erase(counts)
    return _Frequent(folded)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


class _Frequent:
    """Frequent pieces in arrays: found by hash, then compared."""

    def __init__(self, frequent: pa.Table) -> None:
        n = frequent.num_rows
        pieces = frequent["piece"].chunk(0) if n else pa.array([], pa.binary())
        ids = frequent["ids"].chunk(0) if n else pa.array([], pa.list_(pa.int32()))
        ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes.to_numpy())]).astype(np.int32)
        self.cuts, first = ends(pc.binary_length(pieces)), int(np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset]) if n else 0
        self.pieces = bytes(memoryview(pieces.buffers()[2] or b"")[first : first + int(self.cuts[-1])]) if n else b""  # no object for each piece: the driver has little memory
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(self.pieces[self.cuts[i] : self.cuts[i + 1]]) for i in range(n)), np.uint64, n)
        self.order = np.argsort(self.hashes).astype(np.int32)
        self.hashes = self.hashes[self.order]
        self.ids, self.ends = ids.flatten().to_numpy().astype("<u2").tobytes(), 2 * ends(ids.value_lengths())

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """Where each piece may be; -1 where it is not."""
        if not pieces or not len(self.hashes):
            return np.full(len(pieces), -1)
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, len(pieces))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def found(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids, as bytes, of those that are here."""
        at = self.places(pieces)
        hit = np.flatnonzero(at >= 0)
        k = at[hit]
        spans = (x.tolist() for x in (hit, self.cuts[k], self.cuts[k + 1], self.ends[k], self.ends[k + 1]))
        return {pieces[i]: self.ids[c:d] for i, a, b, c, d in zip(*spans, strict=True) if self.pieces[a:b] == pieces[i]}


class _Numbers(dict):
    """Piece to its number, in the order of first sight; ``new`` lists what was not seen before."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class _Pool:
    """Ids of numbered pieces, and of documents given as numbers."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, "<u2"), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def add(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if not len(numbers):
            return
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), "<u2")])
        if (top := int(numbers.max()) + 1) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(max(len(x), top), np.int64)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[numbers], self.size[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        shift = self.start[numbers] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Coded:
    """A document: its ids, and views of their decimals joined by commas and of the bytes that they decode to."""

    def __init__(self, ids: np.ndarray, id_text: memoryview, decoded: memoryview) -> None:
        self.ids, self._id_text, self._decoded = ids, id_text, decoded

    def __len__(self) -> int:
        return len(self.ids)

    def id_text(self) -> memoryview:
        return self._id_text

    def decoded(self) -> memoryview:
        return self._decoded


class _Spelled:
    """Decimals and bytes of many ids at once, gathered from one array of each."""

    def __init__(self, by_id: list[bytes]) -> None:
        self.decimals, self.pieces = (pa.array(x, pa.large_binary()) for x in ([b"%d," % i for i in range(len(by_id))], by_id))

    def _gathered(self, values: pa.LargeBinaryArray, ids: pa.Array, ends: np.ndarray) -> tuple[memoryview, list[int]]:
        found = values.take(ids)
        _, offsets, data = found.buffers()
        return memoryview(data or b""), np.frombuffer(offsets, np.int64, len(found) + 1)[ends].tolist()

    def coded(self, documents: list[np.ndarray]):
        """In runs of at most ``AT_ONCE`` ids, or of one document."""
        at = 0
        while at < len(documents):
            to, n = at + 1, len(documents[at])
            while to < len(documents) and n + len(documents[to]) <= AT_ONCE:
                n += len(documents[to])
                to += 1
            ids, ends = pa.array(np.concatenate(documents[at:to])), np.concatenate([[0], np.cumsum([len(x) for x in documents[at:to]])])
            (text, cuts), (decoded, edges) = (self._gathered(x, ids, ends) for x in (self.decimals, self.pieces)) if n else ((memoryview(b""), [0] * len(ends)),) * 2
            for k in range(at, to):
                i = k - at
                yield Coded(documents[k], text[cuts[i] : max(cuts[i], cuts[i + 1] - 1)], decoded[edges[i] : edges[i + 1]])
            at = to


def _pieces_by_id(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        pieces[i] = b
    return pieces


def encode_with(docs: DataFrame, ranks: dict[bytes, int], pattern: str, finish, fields: str, names: list[str], max_fold: int = 2048, max_frequent: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", rest: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, the columns ``rest``, ``fields``): ``finish(coded)`` gives a document's values of ``fields``, see :class:`Coded`."""
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids must be below 2**16")
    sc = docs.sparkSession.sparkContext
    shared, table = sc.broadcast(ranks), _pair_table(tuple(ranks.items()))
    keep = [id_col, *rest]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    keep_ddl = ", ".join(f"`_k{i}` {k}" for i, k in enumerate(kinds))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    frequent = sc.broadcast(frequent_pieces(rows, shared, pattern, table, max_frequent))
    pa.default_memory_pool().release_unused()

    k = len(keep)
    sent_names = [*(f"_k{i}" for i in range(k)), "_numbers", "_number", "_word", "_given", "_forget"]

    def ask(batches):
        known, find, often, numbers = shared.value, _finder(pattern), frequent.value, _Numbers()

        def row(types, n, numbers=None, number=None, word=None, given=None, forget=False, kept=None):
            blank = lambda x, t: pa.nulls(n, t) if x is None else x
            kept = kept or [pa.nulls(n, t) for t in types]
            return pa.RecordBatch.from_arrays([*kept, blank(numbers, pa.binary()), blank(number, pa.int32()), blank(word, pa.list_(pa.int32())), blank(given, pa.binary()), pa.array([forget] * n)], names=sent_names)

        for batch in _slices(batches):
            types = batch.schema.types[:k]
            if len(numbers) > FORGET:
                numbers = _Numbers()
                yield row(types, 1, forget=True)
            first, coded = len(numbers), []
            for text in batch.column(k).to_pylist():
                found = find(text)
                coded.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)).tobytes())
            new = [x.encode() for x in numbers.new]
            numbers.new.clear()
            many = often.found([b for b in new if b not in known])
            given, sizes, ids, folds = [], [], [], []
            for n, b in enumerate(new, first):
                if (one := known.get(b)) is not None:
                    x = one.to_bytes(2, "little")
                elif (x := many.get(b)) is None:
                    if len(b) <= max_fold:
                        folds.append((n, b))
                        continue
                    x = np.array(merge_by_heap(b, known), "<u2").tobytes()
                given.append(n)
                sizes.append(len(x) // 2)
                ids.append(x)
            if given:
                yield row(types, 1, given=pa.array([np.array([len(given), *given, *sizes], np.int32).tobytes() + b"".join(ids)], pa.binary()))
            for at in range(0, len(folds), 1 << 14):
                part = folds[at : at + (1 << 14)]
                yield row(types, len(part), number=pa.array([n for n, _ in part], pa.int32()), word=_byte_ids([b for _, b in part], known))
            yield row(types, batch.num_rows, numbers=pa.array(coded, pa.binary()), kept=batch.columns[:k])

    def answer(batches):
        known, pool = shared.value, _Pool()
        spelled = _Spelled(_pieces_by_id(known))
        for batch in batches:
            docs_, number, given, forget, folded = (batch.column(k + i) for i in (0, 1, 3, 4, 5))
            out = []
            # Rows of one kind stand together; a run of them is handled at a time.
            kind = np.select([forget.to_numpy(zero_copy_only=False), given.is_valid().to_numpy(zero_copy_only=False), number.is_valid().to_numpy(zero_copy_only=False)], [3, 2, 1], 0)
            edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for at, to in zip(edges, edges[1:], strict=False):
                if at == to:
                    continue
                if kind[at] == 3:
                    pool = _Pool()
                elif kind[at] == 2:
                    for data in given.slice(at, to - at).to_pylist():
                        n = int(np.frombuffer(data, np.int32, 1)[0])
                        head = np.frombuffer(data, np.int32, 2 * n, 4)
                        pool.add(head[:n], head[n:].astype(np.int64), np.frombuffer(data, "<u2", -1, 4 + 8 * n))
                elif kind[at] == 1:
                    lists = folded.slice(at, to - at)
                    pool.add(number.slice(at, to - at).to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy().astype("<u2"))
                else:
                    for lo in range(at, to, SLICE):
                        some = docs_.slice(lo, min(to - lo, SLICE)).to_pylist()
                        out += map(finish, spelled.coded([pool.ids(np.frombuffer(data, np.int32)) for data in some]))
            if out:
                some = pa.array(kind == 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(some) for i in range(k)), *(pa.array(c) for c in zip(*out, strict=True))], names=[*(f"_k{i}" for i in range(k)), *names])

    asked = rows.mapInArrow(lean(ask), ", ".join([*([keep_ddl] if keep else []), "_numbers binary, _number int, _word array<int>, _given binary, _forget boolean"]))
    folded = asked.withColumn("_ids", F.when(F.col("_word").isNotNull(), fold_merges(F.col("_word"), table)))
    out = written(folded.mapInArrow(lean(answer), f"{keep_ddl}, {fields}"), "bpe", during=DURING)
    frequent.destroy()
    shared.destroy()
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *names)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, **options) -> DataFrame:
    """(id, the columns ``rest``, ids, n_tokens): every text's ids as array<int>."""
    return encode_with(docs, ranks, pattern, lambda c: (c.ids.astype(np.int32), len(c)), "ids array<int>, n_tokens long", ["ids", "n_tokens"], **options)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", as_col: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes of its ids, each id's piece after the other; null ids decode to null."""
    pieces = _pieces_by_id(ranks)

    @F.arrow_udf("binary")
    def joined(column: pa.Array) -> pa.Array:
        return pa.array([None if ids is None else b"".join([pieces[i] for i in ids]) for ids in column.to_pylist()], pa.binary())

    return encoded.withColumn(as_col, joined(ids_col))
