"""Chat formatting, WARC, embeddings, the registered queries, and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import chat_format, embedding_dedup, queries, warc_archive

NASTY = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|", "<\\\\|", "\\", "<", "|im_end|>", "a\\nb\n", "", "<|<||", "\\\\<\\|\\"]


def test_chat_round_trip(spark):
    turns = [(c, t, ["user", "assistant", "system", None, "we\\n<|ird\n"][(c + t) % 5], NASTY[(c * 7 + t) % len(NASTY)] if t % 4 else None, "x") for c in range(12) for t in range(c)]
    turns += [(50, 1, "assistant", "b", "x"), (50, 1, "assistant", "b", "x"), (None, 0, "user", "q", "x"), (51, None, "assistant", "first", "x"), (51, 0, "user", "second", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, context string")
    got = {r.conv_id: r for r in chat_format.digest_chat(chat_format.format_chat(df)).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted(((-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        said = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_chat_examples(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 2, "user", "s")], "conv_id long, turn long, role string, text string")
    one, two = chat_format.format_chat(df).orderBy("example_no").collect()
    assert (one.context, one.reply) == ("<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n", "r")
    assert two.reply is None and two.context == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n<|im_start|>user\ns<|im_end|>\n"


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_warc(spark, min_bytes):
    pages = [(1, "http://a/1", "same page"), (2, "http://a/2\r\nX: y", "same page"), (3, None, "same page"), (4, "u", None), (5, "u", ""), (6, "u", "own ü"), (None, "u", "same page"), (7, "u", "abc"), (8, "u", "abc"), (9, "u", "twice twice"), (9, "u", "twice twice")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, key string")
    records = warc_archive.archive_pages(df, min_bytes)
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = i != top[h or ""] and len(b) >= min_bytes
        want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(top[h or ""] if again else None)))
    got = warc_archive.digest_archive(records)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got.collect()) == sorted(want)
    for r in records.collect():
        assert b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in bytes(r.header) and r.sha1 == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert bytes(r.header) == head + b"\r\n\r\n" and b"\r\nX: y" not in head
        assert block == (b"" if b"WARC-Type: revisit" in head else bytes(r.payload)) + b"\r\n\r\n"
    assert warc_archive.digest_archive(warc_archive.archive_pages(df.limit(0))).count() == 0


def test_warc_leaves_archive_only(spark, tmp_path, monkeypatch):
    """Of the tables in the shared folder only payloads and headers stay."""
    monkeypatch.setattr("textloom.llm.storage.shared_folder", lambda spark: f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "u", "a"), (2, "v", "a"), (3, None, None)], "page_id long, url string, html string")
    assert warc_archive.digest_archive(warc_archive.archive_pages(df)).count() == 3
    assert [p.name.split("-")[0] + "/" + q.name for p in (tmp_path / "textloom").iterdir() for q in sorted(p.iterdir()) if q.is_dir()] == ["warc/headers", "warc/payloads"]
    assert len([*(tmp_path / "textloom").iterdir()]) == 1


def links(ids, vectors, threshold):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    up = list(range(len(ids)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in zip(*np.nonzero(hit), strict=True):
        a, b = sorted((root(a), root(b)))
        up[b] = a
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (int(hit[k].sum()), least[root(k)]) for k, i in enumerate(ids)}


@pytest.mark.parametrize(("interval", "leaf"), [(2048, 128), (16, 4)])
def test_embeddings(spark, interval, leaf):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    good = [*base, *(base[k % 60] + 0.08 * rng.normal(size=8) for k in range(200)), *([base[0]] * 30), *(base[1] * s for s in (2.0, 0.5, -1.0))]
    ids = rng.permutation(len(good)).tolist()
    odd = [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [None] + [1.0] * 7, 0), (1003, [float("nan")] + [1.0] * 7, 0), (1004, [float("inf")] + [1.0] * 7, 0), (1005, [1.0, 2.0], 0), (1006, [], 0)]
    df = spark.createDataFrame([*((i, [float(x) for x in v], 1) for i, v in zip(ids, good, strict=True)), *odd], "vec_id long, embedding array<double>, node long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_embeddings(df, interval=interval, leaf=leaf).collect()}
    want = links(ids, good, 0.95)
    assert got == {**{i: (n, c, i == c) for i, (n, c) in want.items()}, **{i: (0, i, True) for i, _, _ in odd}}
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0
    assert embedding_dedup.near_embeddings(df.where("vec_id = 1001")).collect()[0].kept


def test_embeddings_of_several_lengths_and_ids(spark):
    """Planted links in 64 dimensions and in 3, equal vectors, null and repeated ids."""
    rng = np.random.default_rng(8)
    far = rng.normal(size=(300, 64))
    near = far[:60] + 0.02 * rng.normal(size=(60, 64))
    good = [*far, *near, far[0], far[0]]
    short = [[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 2.0, 0.0]]
    rows = [*((i, v.tolist()) for i, v in enumerate(good)), *((1000 + i, v) for i, v in enumerate(short)), (None, [5.0, 0.0]), (2000, [5.0, 0.0]), (2000, [5.0, 0.0]), (3000, None)]
    got = embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), interval=64, leaf=8).collect()
    told = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 2000}
    assert told == links(list(range(len(good))), good, 0.95) | links([1000 + i for i in range(4)], short, 0.95)
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None or r.vec_id >= 2000) == [("2000", 2, 2000, True), ("2000", 2, 2000, True), ("3000", 0, 3000, True), ("None", 2, 2000, False)]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_pipeline(spark, tmp_path, odd_docs):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(at)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(at)))
        assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
        if at in (1, 2):
            assert docs.count() == docs.select("doc_id").distinct().count()
    last = corpus_pipeline.run(spark, folder)
    assert last.count() == docs.count() and last.where(F.size("ids") != F.col("n_tokens")).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd_docs.select(*corpus_pipeline.COLUMNS), folder).collect()
        stage(spark, odd_docs.select(*corpus_pipeline.COLUMNS).limit(0), folder).collect()
