"""The registered queries without SQL, as they are, on the smallest tables, against plain restatements."""

import hashlib
import math

import public_tokenizers
import pytest
import tiktoken
from test_others import links
from test_texts import RANKS, WORD, classes, removed, simhash, tokens, water_filled

from textloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())


def rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, FOLDER).collect())


def test_byte_bpe(spark, docs):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in docs:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(spark, "op2_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_suffix_dedup(spark, docs):
    got = [(str(i), *r) for i, *r in rows(spark, "op3_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    assert sorted(got) == removed([(i, t) for i, t, _ in docs], 100)


def test_quality_rules(spark, docs):
    got = rows(spark, "op5_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "base_failed", "kept")
    assert [r[:4] for r in got] == [(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or "")) for i, t, _ in docs for w in [WORD.findall(t or "")]]
    assert not any(failed and kept for *_, failed, kept in got) and 0 < sum(r[-1] for r in got) < len(got)


def test_mixing(spark, docs):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    sizes: dict = {}
    for i, _, s in docs:
        sizes[s] = sizes.get(s, 0) + size[i]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    got = rows(spark, "op6_mixing", "doc_id", "size", "source_size", "target", "taken")
    of = {i: s for i, _, s in docs}
    assert [(i, n, m) for i, n, m, _, _ in got] == [(i, size[i], sizes[s]) for i, _, s in docs]
    assert all(abs(target - want[of[i]]) < 1e-6 and taken <= 2 * n for i, n, _, target, taken in got)
    for s, target in want.items():
        assert abs(sum(r[4] for r in got if of[r[0]] == s) - target) <= 0.01 * target + 16


def test_embeddings(spark):
    vectors = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect())
    want = links([i for i, _ in vectors], [v for _, v in vectors], 0.95)
    assert rows(spark, "op8_embeddings", "vec_id", "n_links", "component_id", "kept") == [(i, *want[i], want[i][1] == i) for i, _ in vectors]


def test_simhash(spark, docs):
    prints = {i: simhash(t) for i, t, _ in docs}
    root, least = classes(prints.values(), 4), {}
    for i in sorted(prints, reverse=True):
        least[root[prints[i]]] = i
    assert rows(spark, "op9_simhash", "doc_id", "fingerprint", "component_id") == [(i, f"{p:016x}", least[root[p]]) for i, p in sorted(prints.items())]


def test_pitman_yor(spark, docs):
    import collections
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in docs}
    c = collections.Counter(w for i, t, _ in docs if not held[i] for w in tokens(t))
    n, v = c.total(), len(c)
    got = rows(spark, "op10_pitman_yor", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for (i, h, size, known, train, base, score), (j, t, _) in zip(got, docs, strict=True):
        w = tokens(t)
        assert (i, h, size, known, train) == (j, held[j], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(base, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and score < 0
