"""Operators on documents against plain restatements of their rules."""

import collections
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, line_dedup, mixing, pitman_yor, quality_rules, simhash_dedup, suffix_dedup
from textloom.llm.components import connected_components, forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- components -----------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    path = [(1000 + i, 1001 + i) for i in range(60)]
    edges = [*zip(a.tolist(), b.tolist(), strict=True), *path]
    want = {}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in edges:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    want = {x: root(x) for x in up if root(x) != x}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    u, v = forest(np.array([x for x, _ in edges]), np.array([y for _, y in edges]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- line dedup -----------------------------------------------------------------------------------------------------


def test_lines(odd_docs, no_docs):
    got = line_dedup.dedup_lines(odd_docs, min_sites=2, band=0.25)
    assert got.columns == [*odd_docs.columns, "_ld_lines", "_ld_removed"]
    data = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    sites, first = collections.defaultdict(set), {}
    for i, t, s in data:
        for k, line in enumerate([] if t is None else t.split("\n")):
            x = line.strip(" \t\n\x0b\x0c\r")
            if x:
                sites[x].add(s)
                place = (i is not None, i or 0, k)
                first[x] = min(first.get(x, place), place)

    def cleaned(i, t):
        if t is None:
            return None
        keep = [x for k, x in enumerate(t.split("\n")) if len(sites[x.strip(" \t\n\x0b\x0c\r")]) < 2 or first[x.strip(" \t\n\x0b\x0c\r")] == (i is not None, i or 0, k)]
        return "\n".join(keep)

    want = sorted((str(i), str(cleaned(i, t))) for i, t, _ in data)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == want
    assert line_dedup.dedup_lines(no_docs).count() == 0


@pytest.mark.parametrize("band", [0.0, 0.25, 0.99])
def test_line_spread_at_the_threshold(spark, band):
    docs = spark.createDataFrame([(100 * n + s, f"line {n}", f"s{s}") for n in range(1, 8) for s in range(n)], "doc_id long, text string, source string")
    got = line_dedup.dedup_lines(docs, min_sites=4, band=band).groupBy("_ld_removed").count().collect()
    assert {r["_ld_removed"]: r["count"] for r in got} == {0: 1 + 2 + 3 + 4, 1: 3 + 4 + 5 + 6}


# --- byte-level BPE -------------------------------------------------------------------------------------------------

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TOKENIZER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("max_frequent", [0, 1 << 10])
def test_bpe(spark, odd_docs, no_docs, max_frequent):
    more = ["anana banana ananas", "a  b   c\n\n d \n", " lead", "trail ", "it's I'LL we've  x", " em space \x1d sep", "ababababab" * 30, "日本語テキスト 中文", " ", "  ", "\n", " a ", "a \n b", "a\n b  c\n", "x\u3000 y \u2028z", "q" + " " * 3000 + "r", "don't  'll 's", "\x00\x01\x7f", "áé", "<|endoftext|>"]
    docs = odd_docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(100 + i, t, "z") for i, t in enumerate(more)], "doc_id long, text string, source string"))
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, rest=("source",), max_frequent=max_frequent, max_fold=200)
    got = sorted((str(r.doc_id), r.ids, r.n_tokens) for r in encoded.collect())
    want = sorted((str(i), TOKENIZER.encode_ordinary(t or "")) for i, t in rows(docs))
    assert [(i, ids) for i, ids, _ in got] == want and all(len(ids) == n for _, ids, n in got)
    back = byte_bpe.decode(encoded, RANKS).select("doc_id", "bytes").collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(i), (t or "").encode()) for i, t in rows(docs))
    assert byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_forgets_in_step(odd_docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "FORGET", 50)
    monkeypatch.setattr(byte_bpe, "SLICE", 2)
    got = byte_bpe.encode(odd_docs.coalesce(1), RANKS, public_tokenizers.PATTERN, max_frequent=16).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), TOKENIZER.encode_ordinary(t or "")) for i, t in rows(odd_docs))


def test_merges_by_heap():
    for piece in (b"anana", b"ababa" * 9, "größenwahnsinnig".encode(), b"x" * 300, b"a"):
        assert byte_bpe.merge_by_heap(piece, RANKS) == TOKENIZER.encode_ordinary(piece.decode())


def test_good_texts_pass_python_once(spark):
    """What is kept is read from a table that was written with few texts at a time; nulls and all columns are as they were."""
    docs = spark.createDataFrame([(1, "z", " ".join(f"w{k}" for k in range(80))), (2, None, None), (None, "y", "é " * 3 + " ".join(f"v{k}" for k in range(60)))], "doc_id long, more string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_rules.keep_good(docs, labels)
    assert kept.inputFiles() and kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.text)


def test_bpe_finder():
    """Matches are those of `regex`, on every character of the basic plane and beyond, in less time than it takes."""
    own = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{byte_bpe.WHITE}").replace(r"\S", f"[^{byte_bpe.WHITE}]").replace(r"\s", f"[{byte_bpe.WHITE}]")
    slow, find = regex.compile(own).findall, byte_bpe._finder(public_tokenizers.PATTERN)
    every = [chr(i) for i in range(1 << 16) if not 0xD800 <= i < 0xE000]
    for text in ("".join(every), "".join(f" {c}a{c} 1{c}. {c}" for c in every), "a \U0001d400b \U0001f600\U00010d30 1", "", "it's  we'll \n\n x\x1c \x85y "):
        assert find(text) == slow(text)
    text, took = " the quick brown Füchse, 1234 don't " * 3000, {}
    for f in (slow, find):
        times = []
        for _ in range(5):
            began = time.thread_time()
            f(text)
            times.append(time.thread_time() - began)
        took[f] = min(times)
    assert took[find] < 0.8 * took[slow]


def test_bpe_spelled_at_once(monkeypatch):
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 4)
    pieces = byte_bpe._pieces_by_id(RANKS)
    docs = [np.array(x, "<u2") for x in ([], [5], [], [1, 2, 300], [], [7] * 9, [50000 - 1, 0], [], [])]
    got = list(byte_bpe._Spelled(pieces).coded(docs))
    assert [bytes(c.id_text()).decode() for c in got] == [",".join(map(str, x.tolist())) for x in docs]
    assert [bytes(c.decoded()) for c in got] == [b"".join(pieces[i] for i in x) for x in docs]


# --- suffix-array dedup ---------------------------------------------------------------------------------------------


def removed(docs, length):
    seen, out = set(), []
    for i, t in docs:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                m[k : k + length] = b"\1" * length
            else:
                seen.add(b[k : k + length])
        spans = sum(1 for k in range(len(b)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((str(i), len(b), sum(m), spans, hashlib.sha256(bytes(x for x, f in zip(b, m, strict=True) if not f)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [100, 30])
def test_suffixes(odd_docs, no_docs, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 5000)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 9000)
    got = suffix_dedup.dedup_runs(odd_docs, length).collect()
    ordered = sorted(rows(odd_docs), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(ordered, length)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in got)
    assert suffix_dedup.dedup_runs(no_docs).count() == 0


def test_suffixes_without_repeats(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "".join(chr(97 + (i * i) % 26) for i in range(90)))], "doc_id long, text string")
    assert {r.n_removed for r in suffix_dedup.dedup_runs(docs).collect()} == {0}


def test_suffixes_with_hot_prefixes(spark, make_prose, monkeypatch):
    """Half of the text starts with two bytes, one passage is in every other document among unlike neighbours, and runs go on over ranges."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2500)
    prose = make_prose
    passage, other = prose(40, 77), prose(30, 78)
    texts = ["ab" * 200 + prose(20, k) if k % 3 == 0 else prose(15, k) + passage[k % 7 :] + prose(15, 100 + k) + (other if k % 2 else other[5:]) for k in range(60)]
    texts += [passage * 3, "x" * 400, "xy" + "x" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = suffix_dedup.dedup_runs(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(list(enumerate(texts)), 100)


def test_suffix_names(spark, make_prose, monkeypatch):
    """Names cover 100 bytes after four levels, rows are sorted by all their keys, and cuts are looked up in them."""
    levels = []
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2500)
    monkeypatch.setattr(suffix_dedup._Names, "named", lambda self, *a, f=suffix_dedup._Names.named: (levels.append(1), f(self, *a))[1])
    texts = [make_prose(15, k) + make_prose(40, 77) + make_prose(15, 50 + k) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.dedup_runs(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(list(enumerate(texts)), 100)
    assert 0 < len(levels) <= 4
    rng = np.random.default_rng(4)
    for bits in (9, 20, 24, 40):
        s = rng.integers(0, 1 << bits, 400).astype(np.uint64)
        s[rng.random(400) < 0.8] = 7
        at, span = np.arange(400), suffix_dedup._span(bits)
        keys, which = suffix_dedup._distinct(suffix_dedup._windows(s, at, bits))
        windows = [(*s[i : i + span].tolist(), *[0] * (i + span - 400)) for i in at]
        assert [sorted(set(windows)).index(w) for w in windows] == which.tolist()
        some = np.sort(rng.choice(len(keys[0]), 9, replace=False))
        cuts = [k[some] + np.uint64(j == len(keys) - 1) for j, k in enumerate(keys)]
        assert suffix_dedup._before_rising(keys, cuts).tolist() == suffix_dedup._before(keys, cuts).tolist()


def test_merge_order():
    rng = np.random.default_rng(5)
    s = rng.integers(1, 4, 200).astype(np.uint64)
    suffixes = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    rank = np.zeros(len(s) + 3, np.uint64)
    rank[suffixes] = np.arange(1, len(s) + 1)
    at, padded = np.arange(len(s)), np.concatenate([s, np.zeros(3, np.uint64)])
    own = np.where(at % 3 > 0, rank[: len(s)], 0).astype(np.uint64)
    got = suffix_dedup.merge_order(at % 3, s, padded[at + 1], own, rank[at + 1], rank[at + 2])
    assert (got + np.uint64(1)).tolist() == rank[: len(s)].tolist()


# --- quality rules --------------------------------------------------------------------------------------------------


def test_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, None), (7, 1, 1), (14, 0, 0), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality_rules.score_quality(odd_docs, labels)
    texts = rows(odd_docs)
    target, raw = collections.Counter(), collections.Counter()
    for i, t in texts:
        g = np.concatenate([*quality_rules.grams((t or "").encode(), 4), np.zeros(0, np.int64)]).astype(int).tolist()
        raw.update(g)
        if i in (1, 6):
            target.update(g)
    size = 1 << quality_rules.BUCKET_BITS
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size))
    want = []
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        marked, lines = set(), [x for x in t.split("\n") if WORD.search(x)]
        for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
            if windows[x] > 1:
                marked |= {k, k + 1, k + 2}
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        g = np.concatenate([*quality_rules.grams(t.encode(), 4), np.zeros(0, np.int64)]).astype(int).tolist()
        score = sum(map(ratio, g)) / max(1, len(g))
        want.append((str(i), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked), failed, round(score, 6), not failed and score >= -0.5))
    got = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.score, 6), r.kept) for r in scored.collect()]
    assert sorted(got) == sorted(want)
    kept = quality_rules.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(x[-1] for x in want)
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in odd_docs.collect()}
    assert quality_rules.score_quality(no_docs, labels.limit(0)).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------------------


def water_filled(sizes, weights, budget, cap):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while True:
        left, total = budget - sum(target[s] for s in sizes if s not in open_), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > cap * sizes[s]}
        if not over:
            return {s: left * weights[s] / total if s in open_ else target[s] for s in sizes}
        for s in over:
            target[s] = cap * sizes[s]
        open_ -= over


def test_mix(spark, no_docs):
    data = [(i, " ".join(["w"] * (i % 37)), [None, "a", "b", "c", "d"][min(4, i % 9)]) for i in range(900)] + [(7, "x y", "a"), (7, "x y", "a"), (None, "z z", None), (901, None, "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(docs, block_words=8, shard_words=600).collect()
    again = mixing.mix(docs.repartition(7), block_words=8, shard_words=600).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(data)
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_filled(sizes, dict(zip(order, itertools.cycle((5, 2, 1)), strict=False)), 1.5 * sizes.total(), 2)
    by_id = collections.defaultdict(list)
    for i, t, s in data:
        by_id[i].append((len(WORD.findall(t or "")), s))
    taken = collections.Counter()
    for r in got:
        size, source = by_id[r.doc_id][0] if r.doc_id != 7 else next(x for x in by_id[7] if x[0] == r["size"])
        assert r["size"] == size and r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6 and 0 <= r.taken <= 2 * size
        taken[source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.03 * t + 16
    assert mixing.mix(no_docs).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns


def test_mix_of_odd_rows(spark, odd_docs):
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in odd_docs.collect()}
    # Null ids are dealt by their texts, and a source of a few words comes near its target as well.
    docs = spark.createDataFrame([(None, f"w{i} " * (1 + i % 40), "a") for i in range(400)] + [(i, "b " * 9, "b") for i in range(3)], "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_words=500).collect()
    for size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8 + 0.02 * size and all(r.taken <= 2 * r["size"] for r in mine)


def test_lines_of_a_long_text(spark):
    lines = [f"line {k} of a text" for k in range(20000)]
    docs = spark.createDataFrame([(i, "\n".join([f"own {i}", *lines, "end"]), f"s{i}") for i in range(11)], "doc_id long, text string, source string")
    got = {r.doc_id: (r["_ld_lines"], r["_ld_removed"], r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0][:2] == (20002, 0) and all(got[i] == (20002, 20001, f"own {i}") for i in range(1, 11))


def test_sainte_lague(spark):
    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 61, "e": 0}
    for seats in (1, 7, 100, 1001):
        d = spark.createDataFrame([(k, float(v), seats) for k, v in votes.items()], "k string, v double, s long")
        got = {r.k: r.quota for r in mixing.sainte_lague(d, [], ["k"], "v", "s").collect()}
        quotients = sorted(((-v / (2 * j + 1), j, k) for k, v in votes.items() if v for j in range(seats)))[:seats]
        assert got == {k: sum(q[2] == k for q in quotients) for k in votes}


# --- SimHash --------------------------------------------------------------------------------------------------------


def simhash(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius):
    prints, up = sorted(set(prints)), {}
    for p in prints:
        up[p] = p

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {p: root(p) for p in prints}


def test_simhash(odd_docs, no_docs):
    got = simhash_dedup.simhash_classes(odd_docs)
    texts = rows(odd_docs)
    prints = [simhash(t) for _, t in texts]
    root = classes(prints, 4)
    least = {}
    for (i, _), p in zip(texts, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = sorted((str(i), f"{p:016x}", str(least.get(root[p]))) for (i, _), p in zip(texts, prints, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == want
    kept = simhash_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(root.values()))
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in odd_docs.collect()}
    assert simhash_dedup.simhash_classes(no_docs).count() == 0


@pytest.mark.parametrize(("shard_rows", "tree_rows", "pretended"), [(64, 4096, 0), (1, 8, 0), (1, 4, 1 << 17), (1, 8, 1 << 25)])
def test_bk_trees(spark, shard_rows, tree_rows, pretended):
    """The number of agreeing blocks follows the number of nodes: 1, 1, 2 and 3 here."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist()
    prints = {b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 5, 7)} | {base[0] ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "_fp long")
    found = connected_components(simhash_dedup.link_forest(nodes, 4, max(len(prints), pretended), shard_rows, tree_rows))
    parts = {r.node: r.component for r in found.collect()}
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for p in prints:
        groups[parts.get(signed(p), signed(p))].add(p)
    for p, r in classes(prints, 4).items():
        want[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# --- Pitman-Yor -----------------------------------------------------------------------------------------------------


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def test_pitman_yor_base(odd_docs, no_docs):
    texts = rows(odd_docs)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = c.total(), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in texts)
    got = pitman_yor.score_texts(odd_docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sorted(map(str, got)) == sorted(map(str, pitman_yor.score_texts(odd_docs).collect()))
    assert pitman_yor.score_texts(no_docs).count() == 0


def test_pitman_yor_sums_to_one(spark):
    """All words end alike, so they are one context: with e = p(end | word), sums over texts of one and two words tell e twice."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = ["alphaxyz", "bravoxyz", "deltaxyz", "unknownxyz"]
    train = [(i, " ".join(words[(i * k + k * k) % 3] for k in range(i % 6))) for i in range(300) if not held(i)]
    texts = ["", *words, *(f"{words[0]} {w}" for w in words)]
    asked = [i for i in range(1000, 1400) if held(i)][: len(texts)]
    docs = spark.createDataFrame([*train, *zip(asked, texts, strict=True)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in pitman_yor.score_texts(docs).collect()}
    p = {t: 10 ** score[i] for i, t in zip(asked, texts, strict=True)}
    end = 1 - sum(p[f"{words[0]} {w}"] for w in words) / p[words[0]]
    assert 0 < end < 1 and abs(sum(p[w] for w in words) - end * (1 - p[""])) < 1e-9


def test_pitman_yor_whole_contexts(spark):
    """Seatings of one table a dish against a plain restatement: words that end alike are contexts of their own, at any number of buckets."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = {i: " ".join(f"w{(i * k + k * k) % (5 + i % 9)}ending" for k in range(i % 12)) for i in range(400)}
    seqs = {i: [None, *t.split(), "\n"] for i, t in texts.items()}
    c = collections.Counter(x for i, s in seqs.items() if not held(i) for x in zip(s, s[1:], strict=False))
    of, root = collections.Counter(), collections.Counter(w for _, w in c)
    for (u, _), k in c.items():
        of[u] += k
    tables = collections.Counter(u for u, _ in c)
    share = lambda v: min(0.95, max(0.05, v.count(1) / max(1, v.count(1) + 2 * v.count(2))))
    d, d_root = share([*c.values()]), share([*root.values()])
    base = lambda w: ((root[w] - d_root) if w in root else 1 + d_root * len(root)) / (1 + len(c))
    p = lambda u, w: (max(0, c[u, w] - d * ((u, w) in c)) + (1 + d * tables[u]) * base(w)) / (1 + of[u])
    want = {i: sum(math.log10(p(u, w)) for u, w in zip(s, s[1:], strict=False)) for i, s in seqs.items()}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    for size in (1 << 25, 512):
        got = {r.doc_id: r.score for r in pitman_yor.score_texts(docs, sweeps=0, long=None, bucket_bytes=size).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_pitman_yor_workers_give_memory_back(spark, monkeypatch):
    """Every function that runs in Python workers, the last one included, ends by giving free memory back."""
    docs = spark.createDataFrame([(k, f"a b c {k}") for k in range(20)], "doc_id long, text string")
    frame, lean = type(docs), []
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, f=frame.mapInArrow: (lean.append(run.__qualname__), f(self, run, *a))[1])
    assert pitman_yor.score_texts(docs, sweeps=1).count() == 20
    assert lean and all(name.startswith("lean.") for name in lean)


def test_pitman_yor_beats_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = pitman_yor.score_texts(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > 0.8 * held.b


def test_table_sampling():
    """For few customers the sampled numbers of tables follow their weights."""
    d, a, c, n = 0.5, 0.8, 6, 40000
    s = pitman_yor.log_stirling(d, pitman_yor.EXACT)
    t = pitman_yor.sample_tables(np.full(n, c), np.full(n, a), d, s, np.random.default_rng(1))
    w = np.exp(s[c, 1 : c + 1]) * a ** np.arange(1, c + 1)
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - w / w.sum()).max() < 0.01
    many = pitman_yor.sample_tables(np.full(200, 5000), np.full(200, a), d, s, np.random.default_rng(2))
    assert 1 <= many.min() and many.max() <= 5000
