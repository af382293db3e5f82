"""Language-model scoring with a hierarchical Pitman-Yor model over the cluster.

Tokens are words and one end per text. Each token is a customer of the
restaurant of its context; all context restaurants share the root as parent,
whose base is diffuse: a new table there is a word not seen in training. A
context is the whole word before (its 64-bit hash), so there are as many
restaurants as words. Where ``long`` is given, words of over so many bytes share
the restaurant of their last three bytes; that is a smaller model.

Seating is sampled by Gibbs sweeps: given all other tables, the number of tables
t at which the c customers of a dish in a restaurant sit has weight
S_d(c, t) a**t, with S_d the generalised Stirling numbers of the discount and
a = (strength + d tables of the restaurant) P_root(dish); it is drawn from that
at any number of customers: S_d by its recursion up to ``EXACT``, beyond that by
Cauchy's integral. A sweep samples all dishes at once against the
totals of the sweep before; scores average the predictive probabilities of the
sweeps after the first. Discounts come from the counts of counts.

Layout: each chunk of documents is inverted once into (word bucket, chunk) rows
that hold its words, their contexts, and the documents of each occurrence. The
training counts of a bucket are merged over chunks into one row, with all the
contexts that its words have anywhere. A restaurant is spread over the buckets
of its dishes: after each sweep a bucket sends its tables by ranges of context
hashes, each range is added up, and a bucket gets back the totals of its own
contexts in order. Only sums over the whole pass the driver. Sampling is seeded
by bucket and sweep, so a later job replays earlier sweeps from these totals
instead of storing seats, and a lost executor changes nothing. To score, a
bucket's row meets its rows of chunks, in groups of ``GROUP`` chunks so that a
bucket with a very frequent word is split over tasks; each gives sums per
document, which are added up by chunk.

Every training token is seated and every text scored whole, without caps on
words, contexts or counts.

Defined results: a null or empty text is one end token; the null id counts as
empty text for the held-out rule; rows with null or repeated ids are scored as
rows of their own; with no training text, all tokens are unknown and have
probability one in the model; words and contexts are told apart by 64-bit hashes; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import CLEANUP, FEW_TEXTS, erase, lean, new_path, settings, written

EXACT, GROUP, NODES, ROUNDS = 256, 64, 20, 4
#: Rows have some MB: whole batches of them stand in Spark (where Parquet is read, and on the way to Python) and in Python.
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2", "spark.sql.parquet.columnarReaderBatchSize": "4"}
#: Keys of pairs: the word's place above, its context's place below.
PLACE_BITS, PLACE = np.uint64(32), np.uint64((1 << 32) - 1)
#: A chunk ends after so many tokens, or documents (whose places have 15 bits; the 16th marks held-out ones).
CHUNK_TOKENS, CHUNK_DOCS, HELD = 3 << 20, 1 << 15, 1 << 15
#: Neither can be a word.
END, BEGIN = b" ", b"\n"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _pack_places(x: np.ndarray) -> bytes:
    """Differences, low bytes before high ones: within a pair documents ascend."""
    d = np.diff(x, prepend=x.dtype.type(0)).astype("<u2")
    return _pack(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 2).T))


def _open_places(data: bytes) -> np.ndarray:
    d = np.ascontiguousarray(_open(data, np.uint8).reshape(2, -1).T).view("<u2").ravel()
    return np.cumsum(d, dtype=np.uint16)


def _pack_sorted(x: np.ndarray) -> bytes:
    """Differences of ascending hashes, byte by byte: the high bytes are mostly zeros."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return _pack(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T))


def _open_sorted(data: bytes) -> np.ndarray:
    d = np.ascontiguousarray(_open(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(d, dtype=np.uint64)


def _each(batch: pa.RecordBatch):
    """Rows one at a time, as they hold large binaries."""
    for k in range(batch.num_rows):
        yield tuple(batch.column(i)[k].as_py() for i in range(batch.num_columns))


def _open(data: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind) if data else np.zeros(0, kind)


def context_of(word: bytes, long: int | None = None) -> int:
    """The hash of the whole word, or of the ending of one that has over ``long`` bytes."""
    return xxhash.xxh64_intdigest(word) if long is None or len(word) <= long else xxhash.xxh64_intdigest(word[-3:], 1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _invert(n_buckets: int, names: list[str], long: int | None):
    """Documents (id, held, text) to rows of documents (bucket -1) and of (bucket, chunk)."""

    def rows_of(chunk: int, id_type, docs: list, words: _Words, parts: list[np.ndarray]):
        ids, held, sizes = zip(*docs, strict=True)
        n = len(ids)
        none = lambda k: [pa.nulls(k, pa.binary())] * 7
        yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int64()), pa.array([chunk] * n, pa.int64()), *none(n), pa.array(range(n), pa.int64()), pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64())], names=names)
        tokens = np.concatenate(parts)
        place = np.repeat(np.arange(n) + np.where(held, HELD, 0), sizes).astype("<u2")
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        spelled = list(words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, spelled), np.uint64, len(spelled))
        contexts = hashes if long is None else np.fromiter((context_of(x, long) for x in spelled), np.uint64, len(spelled))
        every, of = np.unique(np.append(contexts, np.uint64(context_of(BEGIN, long))), return_inverse=True)
        context = np.empty(len(tokens), np.uint32)
        context[1:] = of[tokens[:-1]]
        context[starts] = of[-1]
        order = np.lexsort((hashes, hashes % np.uint64(n_buckets)))
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order))
        keys = rank[tokens] << PLACE_BITS | context
        parts.clear()
        del tokens, context
        by = np.argsort(keys, kind="stable")
        keys, place = keys[by], place[by]
        del by
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        occurs = np.diff(np.append(first, len(keys)))
        train = np.add.reduceat((place < HELD).astype(np.int64), first)
        pair_word = (keys[first] >> PLACE_BITS).astype(np.int64)
        pair_context = (keys[first] & PLACE).astype(np.uint32)
        hashes = hashes[order]
        buckets = (hashes % np.uint64(n_buckets)).astype(np.int64)
        per_word = np.bincount(pair_word, minlength=len(hashes))
        word_cuts = np.searchsorted(buckets, np.arange(n_buckets + 1))
        pair_cuts = np.searchsorted(pair_word, word_cuts)
        token_cuts = np.append(first, len(keys))[pair_cuts]
        for b in np.flatnonzero(np.diff(word_cuts)).tolist():
            w, p, t = (slice(c[b], c[b + 1]) for c in (word_cuts, pair_cuts, token_cuts))
            heads, at = np.unique(pair_context[p], return_inverse=True)
            packed = [_pack_sorted(hashes[w]), _pack(per_word[w].astype("<u4")), _pack_sorted(every[heads]), *(_pack(v.astype("<u4")) for v in (at, train[p], occurs[p]))]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([chunk], pa.int64()), *(pa.array([v], pa.binary()) for v in packed), pa.array([_pack_places(place[t])], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, id_type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64())], names=names)

    def run(batches):
        chunk, docs, words, parts, held_tokens, id_type = TaskContext.get().partitionId() << 24, [], _Words(), [], 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, held, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                tokens = (text or b"").lower().split()
                tokens.append(END)
                parts.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                docs.append((i, held, len(tokens)))
                held_tokens += len(tokens)
                if held_tokens >= CHUNK_TOKENS or len(docs) >= CHUNK_DOCS:
                    yield from rows_of(chunk, id_type, docs, words, parts)
                    chunk, docs, words, parts, held_tokens = chunk + 1, [], _Words(), [], 0
        if docs:
            yield from rows_of(chunk, id_type, docs, words, parts)

    return run


def invert(docs: DataFrame, n_buckets: int, id_col: str, text_col: str, held_modulus: int, held_remainder: int, long: int | None) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["bucket", "chunk", "words", "pairs", "heads", "contexts", "train", "occurs", "places", "place", "id", "held", "n_tokens"]
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % held_modulus == held_remainder
    rows = docs.select(id_col, held.alias("_held"), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(lean(_invert(n_buckets, names, long)), f"bucket long, chunk long, words binary, pairs binary, heads binary, contexts binary, train binary, occurs binary, places binary, place long, id {id_type}, held boolean, n_tokens long")


def _merged(words: list, per_word: list, contexts: list, counts: list):
    """One sorted copy of several (words, pairs per word, contexts, counts)."""
    known, at = np.unique(np.concatenate(words), return_inverse=True)
    heads, u = np.unique(np.concatenate(contexts), return_inverse=True)
    keys = np.repeat(at.astype(np.uint64), np.concatenate(per_word)) << PLACE_BITS | u.astype(np.uint64)
    c = np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, c = keys[order], c[order]
    if not len(keys):
        return known, np.zeros(len(known), np.int64), np.zeros(0, np.uint64), c
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys = keys[first]
    return known, np.bincount((keys >> PLACE_BITS).astype(np.int64), minlength=len(known)), heads[(keys & PLACE).astype(np.int64)], np.add.reduceat(c, first)


def _merge_counts(batches):
    """Rows in order of buckets to one row a bucket, of what training has seen, and with all contexts (``heads``, ascending)."""
    now, held, heads, size = None, [[], [], [], []], [], 0

    def made():
        known, per_word, contexts, c = _merged(*held)
        seen, every = per_word > 0, np.unique(np.concatenate(heads))
        packed = (_pack_sorted(known[seen]), _pack(per_word[seen].astype("<u4")), _pack_sorted(every), _pack(np.searchsorted(every, contexts).astype("<u4")), _pack(c.astype("<i8")))
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([v], pa.binary()) for v in packed)], names=["bucket", "words", "pairs", "heads", "contexts", "counts"])

    for batch in batches:
        for bucket, words, pairs, head, contexts, train in _each(batch):
            if bucket != now:
                if now is not None:
                    yield made()
                now, held, heads, size = bucket, [[], [], [], []], [], 0
            t, n = _open(train, "<u4"), _open(pairs, "<u4").astype(np.int64)
            ends = np.cumsum(n)
            some = t > 0
            kept = np.concatenate([[0], np.cumsum(some)])
            heads.append(_open_sorted(head))
            for to, v in zip(held, (_open_sorted(words), kept[ends] - kept[ends - n], heads[-1][_open(contexts, "<u4")[some]], t[some].astype(np.int64)), strict=True):
                to.append(v)
            size += len(n) + int(some.sum()) + len(heads[-1])
            if size > 1 << 22:  # partial sums, so that memory follows what is distinct
                held, heads = [[v] for v in _merged(*held)], [np.unique(np.concatenate(heads))]
                size = 0
    if now is not None:
        yield made()


def log_stirling(d: float, n: int) -> np.ndarray:
    """log S_d(c, t): S(c+1, t) = S(c, t-1) + (c - d t) S(c, t)."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(n):
        t = np.arange(1, n + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)) + s[c, 1:], -np.inf)
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay)
    return s


def _root_of(rising, shape) -> np.ndarray:
    """log of w in (0, 1) where ``rising(log w, log(1 - w))`` passes zero."""
    low, high = np.full(shape, -700.0), np.full(shape, 700.0)
    for _ in range(60):
        v = (low + high) / 2
        up = rising(-np.logaddexp(0, -v), -np.logaddexp(0, v)) > 0
        low, high = np.where(up, low, v), np.where(up, v, high)
    return -np.logaddexp(0, -(low + high) / 2)


def log_power_term(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log of S_d(c, t) t! / c!, the coefficient of x**c in ((1 - (1 - x)**d) / d)**t.

    Cauchy's integral on the parabola w0 (1 + i s)**2 in w = 1 - x around the cut, through the saddle point w0.
    """
    grow = lambda w, v: np.log(c + 1) - v - np.log(t * d) + (1 - d) * w + np.log(-np.expm1(d * w))
    w0 = np.exp(_root_of(grow, c.shape))
    e = 1 - w0**d
    bend = t * d * ((1 - d) * w0**d / e - d * (w0**d / e) ** 2) + (c + 1) * (w0 / (1 - w0)) ** 2  # w0**2 times the second derivative
    width = 0.5 / np.sqrt(bend)
    step = 0.16 * np.sqrt(1 - d)  # the integrand falls as exp(-y**2 / (4 - 4 d)) at y widths
    s = step * np.arange(80) * width[..., None]
    w = w0[..., None] * (1 + 1j * s) ** 2
    f = t[..., None] * np.log((1 - w**d) / d) - (c[..., None] + 1) * np.log(1 - w)
    top = f[..., :1].real
    y = (np.exp(f - top) * (1 + 1j * s)).real
    return top[..., 0] + np.log(2 * w0 / np.pi * step * width * (y.sum(axis=-1) - y[..., 0] / 2))


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def _sample_many(c: np.ndarray, log_a: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables from S_d(c, t) a**t on ten standard deviations around the mean, its smooth part interpolated from ``NODES`` places."""
    w = _root_of(lambda w, v: np.log(c) + (1 - d) * w - log_a - v, c.shape)
    mean = np.clip(np.exp(np.minimum(log_a, 700)) * -np.expm1(d * w) / d, 1, c)
    low = np.maximum(1, np.floor(mean - 10 * np.sqrt(mean) - 20))
    high = np.minimum(c, np.ceil(mean + 10 * np.sqrt(mean) + 20))
    places = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
    at = low[:, None] + (high - low)[:, None] * (places + 1) / 2
    smooth = log_power_term(d, np.repeat(c[:, None], NODES, 1), at) - np.log(at)
    series = np.polynomial.chebyshev.chebvander(places, NODES - 1)
    terms = np.linalg.solve(series, smooth.T).T
    factorials, out, u = _log_factorials(int(high.max())), np.empty(len(c), np.int64), rng.random(len(c))
    for k in range(len(c)):
        t = np.arange(int(low[k]), int(high[k]) + 1)
        x = 2 * (t - low[k]) / max(1.0, high[k] - low[k]) - 1
        p = np.polynomial.chebyshev.chebval(x, terms[k]) + np.log(t) - factorials[t] + t * log_a[k]
        p = np.exp(p - p.max()).cumsum()
        out[k] = t[min(np.searchsorted(p, u[k] * p[-1], side="right"), len(t) - 1)]
    return out


def sample_tables(c: np.ndarray, a: np.ndarray, d: float, stirling: np.ndarray, rng) -> np.ndarray:
    """Tables for dishes with c customers, each new table with weight a."""
    t = np.ones(len(c), np.int64)
    log_a = np.log(np.maximum(a, 1e-300))
    order = np.argsort(c, kind="stable")
    cuts = np.searchsorted(c[order], np.arange(EXACT + 2))
    for n in range(2, EXACT + 1):
        step = (1 << 19) // n
        for lo in range(cuts[n], cuts[n + 1], step):
            at = order[lo : min(cuts[n + 1], lo + step)]
            w = stirling[n, 1 : n + 1] + np.arange(1, n + 1) * log_a[at, None]
            w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[at] = 1 + (w < rng.random(len(at))[:, None] * w[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    for lo in range(0, len(many), 1 << 8):
        at = many[lo : lo + (1 << 8)]
        t[at] = _sample_many(c[at].astype(float), log_a[at], d, rng)
    return t


def _seatings(bucket: int, per_word: np.ndarray, contexts: np.ndarray, counts: np.ndarray, every: list[np.ndarray], state: dict):
    """Replays the sweeps for which totals are known (``every``, of the bucket's contexts) and one more: yields (tables, root customers per word) of each.

    One customer has one table, so only pairs with more are drawn, and all that is kept per draw is theirs.
    """
    starts = np.cumsum(per_word) - per_word
    t = np.ones(len(counts), np.int32)
    root = per_word.astype(np.int64)
    yield t, root
    if not every:
        return
    some = np.flatnonzero(counts > 1)
    word, contexts, counts = (np.searchsorted(starts, some, side="right") - 1).astype(np.int32), contexts[some], counts[some]
    for sweep, totals in enumerate(every):
        rng = np.random.default_rng([state["seed"], bucket, sweep])
        p_root = (root - state["d_root"]) / (state["strength"] + state["sums"][sweep])
        a = (state["strength"] + state["d"] * totals[contexts]) * p_root[word]
        t = np.ones(len(t), np.int32)
        t[some] = sample_tables(counts, a, state["d"], state["stirling"], rng)
        root = np.add.reduceat(t, starts, dtype=np.int64) if len(starts) else root
        yield t, root


def _row_arrays(pairs: bytes, contexts: bytes, counts: bytes):
    return _open(pairs, "<u4").astype(np.int64), _open(contexts, "<u4"), _open(counts, "<i8")


def _counted(batches):
    """Counts of the whole, per partition: words, tokens, pairs and words of one and of two customers."""
    whole = np.zeros(6, np.int64)
    for batch in batches:
        for pairs, counts in _each(batch):
            per_word, c = _open(pairs, "<u4"), _open(counts, "<i8")
            whole += [len(per_word), c.sum(), (c == 1).sum(), (c == 2).sum(), (per_word == 1).sum(), (per_word == 2).sum()]
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in whole], names=[f"n{k}" for k in range(6)])


def _sent(n_ranges: int, state: dict):
    """A bucket's row to its contexts, their tables after the last sweep and customers, by ranges of contexts."""
    cuts = np.array([(i << 64) // n_ranges for i in range(1, n_ranges)], np.uint64)

    def run(batches):
        for batch in batches:
            for bucket, heads, every, *row in _each(batch):
                per_word, contexts, counts = _row_arrays(*row)
                heads = _open_sorted(heads)
                *_, (t, _) = _seatings(bucket, per_word, contexts, counts, [_open(x, "<i8") for x in every], state)
                tables, customers = (np.bincount(contexts, v, len(heads)).astype("<i8") for v in (t, counts))
                ends = [0, *np.searchsorted(heads, cuts).tolist(), len(heads)]
                for k in range(n_ranges):
                    part = slice(ends[k], ends[k + 1])
                    if ends[k] < ends[k + 1]:
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bucket], pa.int64()), *(pa.array([x], pa.binary()) for x in (_pack_sorted(heads[part]), _pack(tables[part]), _pack(customers[part])))], names=["range", "bucket", "heads", "tables", "customers"])

    return run


def _added(batches):
    """Rows in order of ranges to the totals of each bucket's contexts, and (as bucket -1) the range's tables."""
    now, held = None, []

    def made():
        buckets, heads = [x[0] for x in held], [_open_sorted(x[1]) for x in held]
        _, at = np.unique(np.concatenate(heads), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([_open(x[k], "<i8") for x in held])).astype("<i8") for k in (2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([now], pa.int64()), *(pa.array([_pack(v.sum(keepdims=True))], pa.binary()) for v in sums)], names=["bucket", "range", "tables", "customers"])
        ends = np.cumsum([0, *map(len, heads)])
        for k, bucket in enumerate(buckets):
            mine = at[ends[k] : ends[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([now], pa.int64()), *(pa.array([_pack(v[mine])], pa.binary()) for v in sums)], names=["bucket", "range", "tables", "customers"])

    for batch in batches:
        for k, *row in _each(batch):
            if k != now:
                if now is not None:
                    yield from made()
                now, held = k, []
            held.append(row)
    if now is not None:
        yield from made()


def _in_order(batches):
    """A bucket's ranges put together."""
    now, held = None, []

    def made():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([_pack(np.concatenate([_open(x[k], "<i8") for x in held]))], pa.binary()) for k in range(2))], names=["bucket", "tables", "customers"])

    for batch in batches:
        for bucket, _, *row in _each(batch):
            if bucket != now:
                if now is not None:
                    yield made()
                now, held = bucket, []
            held.append(row)
    if now is not None:
        yield made()


def _with_totals(model: DataFrame, every: list[DataFrame]) -> DataFrame:
    for k, t in enumerate(every):
        model = model.join(t.select("bucket", F.col("tables").alias(f"t{k}")), "bucket")
    return model.withColumn("every", F.array(*(f"t{k}" for k in range(len(every)))).cast("array<binary>"))


def totals(model: DataFrame, n_buckets: int, every: list[DataFrame], state: dict) -> tuple[DataFrame, int]:
    """(bucket, tables, customers) of the restaurants of each bucket's contexts after the last sweep, and the number of all tables."""
    sent = _with_totals(model, every).select("bucket", "heads", "every", "pairs", "contexts", "counts").mapInArrow(lean(_sent(n_buckets, state)), "range long, bucket long, heads binary, tables binary, customers binary")
    sums = sent.repartition(n_buckets, "range").sortWithinPartitions("range").mapInArrow(lean(_added), "bucket long, range long, tables binary, customers binary")
    out = written(sums.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "range").mapInArrow(lean(_in_order), "bucket long, tables binary, customers binary"), "totals", "none", FEW)
    whole = out.where("bucket = -1").first()
    return out, int(_open(whole["tables"], "<i8").sum()) if whole else 0


def _discount(once: int, twice: int) -> float:
    return float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95))


def _score(shared):
    """A bucket's model row (chunk null), then rows of chunks, to sums per document."""

    def load(bucket, words, heads, row, every, customers, state):
        per_word, contexts, counts = _row_arrays(*row)
        known, every = _open_sorted(words), [_open(x, "<i8") for x in every]
        sweeps = []
        for k, ((t, root), tables, n_tables) in enumerate(zip(_seatings(bucket, per_word, contexts, counts, every[:-1], state), every, state["sums"], strict=True)):
            if k >= state["skip"]:
                sweeps.append((counts, t, (root - state["d_root"]) / (state["strength"] + n_tables), tables))
        keys = np.repeat(np.arange(len(known), dtype=np.uint64) << PLACE_BITS, per_word)
        keys |= contexts
        of_word = np.add.reduceat(counts, np.cumsum(per_word) - per_word) if len(per_word) else np.zeros(0, np.int64)
        return known, _open_sorted(heads), keys, sweeps, of_word, _open(customers, "<i8")

    def run(batches):
        state = shared.value
        model = None
        unseen_root = [(state["strength"] + state["d_root"] * state["vocabulary"]) / (state["strength"] + x) for x in state["sums"][state["skip"] :]]
        base_all = np.log10(float(state["n"]) + state["vocabulary"] + 1)
        for batch in batches:
            for bucket, _, chunk, words, pairs, head, contexts, counts, every, of_head, occurs, places in _each(batch):
                if chunk is None:
                    model = None
                    model = load(bucket, words, head, (pairs, contexts, counts), every, of_head, state)
                    continue
                known, heads, keys, sweeps, of_word, customers = model
                w, n, u = _open_sorted(words), _open(pairs, "<u4"), np.searchsorted(heads, _open_sorted(head))[_open(contexts, "<u4")]
                at = np.searchsorted(known, w)
                seen = at < len(known)
                seen[seen] = known[at[seen]] == w[seen]
                at[~seen] = 0
                base = np.where(seen, np.log10((of_word[at] if len(known) else 0) + 1.0), 0.0) - base_all
                pw, ps = np.repeat(at, n), np.repeat(seen, n)
                key = pw.astype(np.uint64) << PLACE_BITS | u.astype(np.uint64)
                pos = np.searchsorted(keys, key)
                hit = ps & (pos < len(keys))
                hit[hit] = keys[pos[hit]] == key[hit]
                pos[~hit] = 0
                p = np.zeros(len(u))
                for (own, t, root, tables), rest in zip(sweeps, unseen_root, strict=True):
                    parent = np.where(ps, root[pw], rest) if len(known) else np.full(len(u), rest)
                    mine = np.where(hit, own[pos] - state["d"] * t[pos], 0.0) if len(keys) else 0.0
                    p += (mine + (state["strength"] + state["d"] * tables[u]) * parent) / (state["strength"] + customers[u])
                logs = np.log10(np.maximum(p / len(sweeps), 1e-300))
                o = _open(occurs, "<u4")
                place = _open_places(places) & np.uint16(HELD - 1)
                size = int(place.max()) + 1
                some = np.flatnonzero(np.bincount(place, minlength=size))
                sums = [np.bincount(place, np.repeat(v, o), size)[some] for v in (logs, np.repeat(base, n), ps.astype(float))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([_pack(v)], pa.binary()) for v in (some.astype("<u2"), sums[0], sums[1], sums[2].astype("<u4")))], names=["chunk", "places", "score", "base", "known"])

    return run


def _by_document(batches):
    chunks: dict[int, list[np.ndarray]] = {}
    now = None

    def made():
        score, base, known = chunks.pop(now)
        n = np.arange(len(score))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), now)), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["chunk", "place", "n_known", "base_score", "score"])

    for batch in batches:
        for chunk, places, score, base, known in _each(batch):
            if chunk != now:
                if now is not None:
                    yield made()
                now = chunk
                chunks[now] = [np.zeros(CHUNK_DOCS) for _ in range(3)]
            at = _open(places, "<u2")
            for to, v in zip(chunks[now], (_open(score, "<f8"), _open(base, "<f8"), _open(known, "<u4")), strict=True):
                to[at] += v
    if now is not None:
        yield made()


def _in_rounds(rows: DataFrame, job, name: str) -> DataFrame:
    """``job`` of a share of the buckets at a time, so that no shuffle has all rows at once; the results are one table."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, name)
    with settings(spark, CLEANUP | FEW):
        for k in range(ROUNDS):
            out = job(rows.where(F.pmod("bucket", F.lit(ROUNDS)) == k))
            out.write.mode("append").parquet(path, compression="none")
    return spark.read.schema(out.schema).parquet(path)


def score_texts(docs: DataFrame, sweeps: int = 3, skip: int = 2, strength: float = 1.0, seed: int = 11, held_modulus: int = 7, held_remainder: int = 2, bucket_bytes: int = 3 << 23, long: int | None = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Contexts are whole words if ``long`` is None. Of the seatings (first, all tables taken by one customer each, then ``sweeps`` samples), the first ``skip`` are not averaged.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_buckets = max(8, -(-n_bytes // bucket_bytes))
    rows = written(invert(docs, n_buckets, id_col, text_col, held_modulus, held_remainder, long), "inverted", "none", FEW_TEXTS)
    chunks = rows.where("bucket >= 0")
    merged = chunks.select("bucket", "words", "pairs", "heads", "contexts", "train")
    fields = "bucket long, words binary, pairs binary, heads binary, contexts binary, counts binary"
    model = _in_rounds(merged, lambda x: x.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_merge_counts), fields), "counts")
    counted = model.select("pairs", "counts").mapInArrow(lean(_counted), ", ".join(f"n{k} long" for k in range(6)))
    with settings(spark, FEW):
        vocabulary, n, c1, c2, r1, r2 = (x or 0 for x in counted.agg(*(F.sum(c) for c in counted.columns)).first())
    state = {"sums": [], "strength": strength, "seed": seed, "d": _discount(c1, c2), "d_root": _discount(r1, r2), "skip": min(skip, sweeps), "vocabulary": int(vocabulary), "n": int(n)}
    state["stirling"] = log_stirling(state["d"], EXACT)
    every = []
    for _ in range(sweeps + 1):
        found, n_tables = totals(model, n_buckets, every, state)
        every.append(found)
        state["sums"].append(n_tables)
    shared = spark.sparkContext.broadcast(state)
    n_chunks = rows.where("bucket < 0").select("chunk").distinct().count()
    groups = F.lit(max(1, -(-n_chunks // GROUP)))
    empty = F.lit(None).cast("binary")
    sent = chunks.select("bucket", F.pmod(F.xxhash64("chunk"), groups).alias("part"), "chunk", "words", "pairs", "heads", "contexts", empty.alias("counts"), F.lit(None).cast("array<binary>").alias("every"), empty.alias("customers"), "occurs", "places")
    heads = _with_totals(model, every).join(every[0].select("bucket", "customers"), "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), groups.cast("long") - 1)))
    heads = heads.select("bucket", "part", F.lit(None).cast("long").alias("chunk"), "words", "pairs", "heads", "contexts", "counts", "every", "customers", empty.alias("occurs"), empty.alias("places"))
    met = lambda x: x.repartition(2 * n_buckets, "bucket", "part").sortWithinPartitions("bucket", "part", F.col("chunk").asc_nulls_first())
    sums = _in_rounds(heads.unionByName(sent), lambda x: met(x).mapInArrow(lean(_score(shared)), "chunk long, places binary, score binary, base binary, known binary"), "sums")
    told = written(rows.where("bucket < 0").select("chunk", "place", F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens"), "texts")
    for done in (rows, model, *every):
        erase(done)
    sums = sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(_by_document), "chunk long, place long, n_known long, base_score double, score double")
    out = told.join(sums, ["chunk", "place"])
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
