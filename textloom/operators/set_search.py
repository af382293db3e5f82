"""Search for all pairs of similar shingle sets, with shingles in packed arrays instead of rows.

Sets that share a Jaccard of num / den or more share a shingle among the first n - ceil(n num / den) + 1
of each, in any common order; here rare ones come first, by exact counts. Shingles of one set only meet
nobody, so they are counted in their set's size and then left out, which is most of them.

1. Sets are dealt by batches and by ranges of hashes (:func:`dealt`), 40 bits a shingle.
2. In each range, shingles of two sets or more stay, with their number (:func:`frequent`).
3. Back in its batch, each set's first shingles are told (:func:`heads`), each with the few before it.
4. In each range again, sets meet (:func:`met`). Two that also have one of those few before in common meet there too
   and are left to that place; the first shingle that they share has none before it, so no pair is lost.
5. What is left is compared whole, in blocks of sets that have candidates in common, each set moved once a block (:func:`compared`).

Hashes of 40 bits that happen to be equal add candidates and lose none. Whole sets are compared by 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Ranges of hashes, bytes of hashes in a batch, how many shingles before one are looked at, and bytes of a word that is hashed with others.
RANGES, BATCH_BYTES, BEFORE, LONG_WORD = 256, 1 << 25, 3, 64
_U, _MIX, _STEP = np.uint64, np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_HEAD = np.dtype([("h", "<u4"), ("set", "<i8"), ("n", "<u4"), ("left", "<u4"), ("before", "<u8", (BEFORE,))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    x = (x ^ (x >> _U(32))) * _MIX
    return x ^ (x >> _U(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each, eight bytes at a time for all words together; of longer ones by BLAKE2b."""
    words = words.cast(pa.large_binary())
    sizes = pc.binary_length(words).to_numpy()
    at = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words.to_pylist()) + bytes(8), np.uint8)
    eight, out = np.lib.stride_tricks.sliding_window_view(data, 8), _mix(sizes.astype(_U) + _STEP)
    left = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    for k in range(0, LONG_WORD, 8):
        left = left[sizes[left] > k]
        if not len(left):
            break
        part = eight[at[left] + k].view(_U).reshape(-1)
        spare = _U(8) * np.maximum(k + 8 - sizes[left], 0).astype(_U)  # bits of the next word
        out[left] = _mix((out[left] ^ (part << spare)) * _STEP)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(words[i].as_py(), digest_size=8).digest(), "little")
    return out


def shingle_sets(plain: pa.Array, k: int = 3) -> list[np.ndarray]:
    """Of each text of words between single blanks, the sorted distinct hashes of its runs of k words; of all words if there are fewer; none of null and empty ones."""
    lists = pc.split_pattern(pc.fill_null(plain, ""), " ")
    words = lists.flatten().dictionary_encode()
    h = word_hashes(words.dictionary)[words.indices.to_numpy()]
    many = max(0, len(h) - k + 1)
    runs = h[:many]
    for j in range(1, k):
        runs = _mix(runs * _STEP + h[j : j + many])
    ends, out, a = np.cumsum(pc.list_value_length(lists).to_numpy()), [], 0
    for b, none in zip(ends.tolist(), pc.fill_null(pc.equal(plain, ""), True).to_pylist(), strict=True):
        if none:
            s = h[:0]
        elif b - a < k:
            s = h[a : a + 1]
            for j in range(a + 1, b):
                s = _mix(s * _STEP + h[j])
            s = _mix(s + _U(b - a))
        else:
            s = np.sort(runs[a : b - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
        a = b
    return out


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _packed(s: np.ndarray) -> bytes:
    """The upper five bytes of each."""
    return s.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(_U).reshape(-1)


def parsed(k: int = 3):
    """(id, row, plain) to (id, row, set, n, s) of texts that have words."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(2), k)
            at = pa.array([i for i, s in enumerate(sets) if len(s)], pa.int64())
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_packed(s) for s in sets], pa.binary())], names=["id", "row", "set", "n", "s"])

    return run


def wholly(k: int = 3):
    """(set, plain) to (set, s), all eight bytes of each hash."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), k)], pa.binary())], names=["set", "s"])

    return run


def _shares(which: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal ones together, and where each begins."""
    return np.argsort(which, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(which, minlength=many))])


def dealt(texts: int):
    """(set, s) to (range, batch, part): a batch's hashes of a range, and by a negative range its sets and their sizes."""

    def rows(sets, packed):
        batch, sizes = sets[0], np.array([len(p) // 5 for p in packed], np.uint32)
        h = _unpacked(b"".join(packed))
        of, low, place = (h >> _U(32)).astype(np.uint8), h.astype(np.uint32), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order, at = _shares(of, RANGES)
        low, place = low[order], place[order]
        kept = [r for r in range(RANGES) if at[r] < at[r + 1]]
        parts = [low[at[r] : at[r + 1]].tobytes() + place[at[r] : at[r + 1]].tobytes() for r in kept]
        kept.append(-1 - (batch & 0x3FFFFFFF))
        parts.append(np.array(sets, np.int64).tobytes() + sizes.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([batch] * len(kept), pa.int64()), pa.array(parts, pa.binary())], names=["range", "batch", "part"])

    def run(batches):
        sets, packed, held = [], [], 0
        for batch in batches:
            for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.append(i)
                packed.append(p)
                held += len(p)
                if len(sets) >= texts or held >= BATCH_BYTES:
                    yield rows(sets, packed)
                    sets, packed, held = [], [], 0
        if sets:
            yield rows(sets, packed)

    return run


def frequent(table: pa.Table) -> pa.Table:
    """Of one range: the hashes of two places or more, with eight times the logarithm of their number."""
    if table.num_rows == 0 or table.column("range")[0].as_py() < 0:
        return table
    parts = table.column("part").to_pylist()
    sizes = [len(p) // 6 for p in parts]
    h = np.concatenate([np.frombuffer(p, np.uint32, m) for p, m in zip(parts, sizes, strict=True)])
    place = np.concatenate([np.frombuffer(p, np.uint16, m, 4 * m) for p, m in zip(parts, sizes, strict=True)])
    order = np.argsort(h)
    ordered = h[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    runs = np.diff(np.append(starts, len(h)))
    count = np.empty(len(h), np.uint32)
    count[order] = np.repeat(runs, runs)
    rank, stays, out, a = np.minimum(8 * np.log2(count), 255).astype(np.uint8), count > 1, [], 0
    for m in sizes:
        at = a + np.flatnonzero(stays[a : a + m])
        out.append(h[at].tobytes() + place[at].tobytes() + rank[at].tobytes())
        a += m
    some = pa.array([len(p) > 0 for p in out])
    return table.set_column(table.column_names.index("part"), "part", pa.array(out, pa.binary())).filter(some)


def heads(num: int, den: int):
    """Of one batch: (range, part) of the hashes that its sets have to show, as rows of ``_HEAD``."""

    def run(table: pa.Table) -> pa.Table:
        h, place, rank, sets = [], [], [], None
        for r, p in zip(table.column("range").to_pylist(), table.column("part").to_pylist(), strict=True):
            if r < 0:
                m = len(p) // 12
                assert sets is None
                sets, sizes = np.frombuffer(p, np.int64, m), np.frombuffer(p, np.uint32, m, 8 * m).astype(np.int64)
                continue
            m = len(p) // 7
            h.append(np.frombuffer(p, np.uint32, m).astype(_U) | _U(r << 32))
            place.append(np.frombuffer(p, np.uint16, m, 4 * m))
            rank.append(np.frombuffer(p, np.uint8, m, 6 * m))
        if not h:
            return pa.table({"range": pa.array([], pa.int32()), "part": pa.array([], pa.binary())})
        h, place, rank = np.concatenate(h), np.concatenate(place), np.concatenate(rank)
        order = np.argsort((place.astype(_U) << _U(48)) | (rank.astype(_U) << _U(40)) | h)
        h, place = h[order], place[order].astype(np.int64)
        shared = np.bincount(place, minlength=len(sets))
        first = np.concatenate([[0], np.cumsum(shared)])[place]
        nth = np.arange(len(h)) - first
        n, at = sizes[place], nth + (sizes - shared)[place]
        shows = at < n + (-n * num // den) + 1
        shows[1:] &= (h[1:] != h[:-1]) | (place[1:] != place[:-1])
        out = np.zeros(int(shows.sum()), _HEAD)
        out["h"], out["set"], out["n"], out["left"] = h[shows], sets[place[shows]], n[shows], (n - at)[shows]
        for j in range(BEFORE):
            before = np.zeros(len(h), _U)
            before[j + 1 :] = h[: -j - 1]
            out["before"][:, j] = np.where(nth > j, before, _U(0))[shows]
        of = (h[shows] >> _U(32)).astype(np.uint8)
        order, at = _shares(of, RANGES)
        out = out[order]
        kept = [r for r in range(RANGES) if at[r] < at[r + 1]]
        return pa.table({"range": pa.array(kept, pa.int32()), "part": pa.array([out[at[r] : at[r + 1]].tobytes() for r in kept], pa.binary())})

    return run


def met(num: int, den: int):
    """Of one range: (x, y), the sets that meet, are of like size, have enough left, and none of the hashes before in common."""

    def run(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("part").to_pylist()), _HEAD)
        x = x[np.lexsort((x["n"], x["h"]))]
        h, sets, n, left, before = x["h"], x["set"].copy(), x["n"].astype(np.int64), x["left"].astype(np.int64), x["before"].copy()
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        runs = np.diff(np.append(starts, len(h)))
        end, i, d, found = np.repeat(starts + runs, runs), np.arange(len(h)), 0, []
        while len(i):
            d += 1
            i = i[i + d < end[i]]
            i = i[n[i + d] * num <= n[i] * den]
            a = i[np.minimum(left[i], left[i + d]) * (num + den) >= (n[i] + n[i + d]) * num]
            for p in range(BEFORE):
                for q in range(BEFORE):
                    b = before[a, p]
                    a = a[(b != before[a + d, q]) | (b == 0)]
            if len(a):
                found.append(np.stack([np.minimum(sets[a], sets[a + d]), np.maximum(sets[a], sets[a + d])]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        pairs = pairs[:, np.lexsort(pairs)]
        new = np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])[: pairs.shape[1]]
        return pa.table({"x": pairs[0][new], "y": pairs[1][new]})

    return run


def _among_best(of: np.ndarray, score: np.ndarray, best: int) -> np.ndarray:
    """Which scores are among the ``best`` highest of the same ``of``, ties with the last of these included."""
    order = np.lexsort((-score, of))
    starts = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(of) else np.zeros(0, np.int64)
    runs = np.diff(np.append(starts, len(of)))
    least = score[order][starts + np.minimum(runs, best) - 1]
    out = np.empty(len(of), bool)
    out[order] = score[order] >= np.repeat(least, runs)
    return out


def compared(num: int, den: int, best: int | None = None):
    """Of one block: its pairs and its whole sets to links; with ``best``, at least those among either set's so many best of the block, ties included."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        ids, data = sets.column("set").to_numpy(), sets.column("s").to_pylist()
        n = np.array([len(s) // 8 for s in data], np.int64)
        x, y, common = pairs.column("x").to_numpy(), pairs.column("y").to_numpy(), np.zeros(pairs.num_rows, np.int64)
        if len(x):
            order = np.argsort(ids)
            ids, n, data = ids[order], n[order], [data[k] for k in order]
            at = np.lexsort((y, x))
            x, y = x[at], y[at]
            i, j = np.searchsorted(ids, x), np.searchsorted(ids, y)
            assert (ids[i] == x).all() and (ids[j] == y).all()
            h, owner = np.frombuffer(b"".join(data), _U), np.repeat(np.arange(len(ids)), n)
            order = np.argsort(h)
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            name = np.empty(len(h), np.int64)
            name[order] = np.cumsum(new) - 1
            shared = np.bincount(name)[name] > 1  # hashes of one set are common to none
            name, many = name[shared], int(new.sum())
            to = np.concatenate([[0], np.cumsum(np.bincount(owner[shared], minlength=len(ids)))])
            own = [name[a:b] for a, b in zip(to, to[1:], strict=False)]
            has, firsts = np.zeros(many, bool), np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(i)], strict=True):
                mine = own[i[a]]
                has[mine] = True
                for k in range(a, b):
                    common[k] = np.count_nonzero(has[own[j[k]]])
                has[mine] = False
            both = n[i] + n[j]
            ok = common * (num + den) >= both * num
            x, y, common, both = x[ok], y[ok], common[ok], both[ok]
        else:
            both = common
        score = common / np.maximum(both - common, 1)
        if best is not None:
            ok = _among_best(x, score, best) | _among_best(y, score, best)
            x, y, common, score = x[ok], y[ok], common[ok], score[ok]
        return pa.table({"x": x, "y": y, "common": common, "jaccard": score})

    return run
