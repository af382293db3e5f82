"""Operators on small inputs with results worked out by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.engine import Config, Engine, chunk, detect_machine_text
from textloom.functions import style as Y
from textloom.functions import text as T
from textloom.operators import relational as R
from textloom.operators import similarity as S
from textloom.operators.encoders import PAIR_SCORERS, hashed_bag
from textloom.sources import files, payloads, sinks
from textloom.streaming.scoring import score_stream

BODY = "The river runs past the old mill and the tall trees that stand along the quiet road to the market town in the valley below the hills."


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_window_bounds():
    assert S.window_bounds([], [], 400, 100, 3) == []
    assert S.window_bounds([3, 3], [True, True], 400, 100, 3) == []
    assert S.window_bounds([450, 3, 3, 3], [True] * 4, 400, 100, 3) == [(1, 4)]
    assert S.window_bounds([1] * 60 + [5] * 3, [False] * 60 + [True] * 3, 400, 100, 3) == [(0, 63)]
    bounds = S.window_bounds([9] * 100, [True] * 100, 400, 100, 3)
    assert bounds[0] == (0, 40) and bounds[1] == (10, 50) and bounds[-1][1] == 100


@pytest.mark.parametrize(("n", "sizes"), [(1500, [1500]), (1501, [1500, 201]), (2600, [1500, 1300]), (2700, [1500, 1400, 100])])
def test_chunks(spark, n, sizes):
    assert [len(x) for x in value(spark, T.char_chunks(F.lit("x" * n)))] == sizes


def test_chunk_ids(spark):
    rows = chunk(spark.createDataFrame([("a", "x" * 1600), ("b", "y")], "doc_id string, text string")).collect()
    assert sorted(r.chunk_id for r in rows) == ["a#chunk0", "a#chunk1", "b"]


def test_paragraphs(spark):
    long, short = "w" * 90, "s" * 20
    d = spark.createDataFrame([(1, f"{short}\n\n{long}\n\n{short}\n\n{long}"), (2, short), (3, "  ")], "doc_id long, text string")
    rows = {(r.doc_id, r.para_no): r.para for r in T.split_paragraphs(d, min_chars=80, fallback=True).collect()}
    assert rows == {(1, 0): f"{long} {short}", (1, 1): long, (2, 0): short}


def test_minhash_error(spark):
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, " ".join(f"w{i}" for i in range(100, 400)))], "id long, text string")
    s = {r.id: r.signature for r in S.signatures(d, "id", "text").collect()}
    j = (300 - 2 - 100) / (298 + 100)
    assert abs(sum(a == b for a, b in zip(s[1], s[2], strict=True)) / 128 - j) < 4 * (j * (1 - j) / 128) ** 0.5
    own = value(spark, S.minhash(T.shingles(T.words(F.lit("one two three four five")))))
    same = S.signatures(spark.createDataFrame([(1, "one two three four five")], "id long, text string"), "id", "text").first().signature
    assert own == same


def test_ties_and_votes(spark):
    m = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (2, 9, 0.95)], "p long, c long, score double")
    assert {(r.p, r.c) for r in S.best_per(m, "p", "score", "c").collect()} == {(1, 3), (2, 9)}
    t = [spark.createDataFrame([(1, c, s)], "q long, c long, cosine double") for c, s in ((5, 0.9), (6, 0.8), (6, 0.7))]
    assert [tuple(r) for r in S.ensemble_vote(t).collect()] == [(1, 6, 2, 0.75)]
    assert S.ensemble_vote(t[:2]).first().c == 5


def test_scores_and_bands(spark):
    assert value(spark, Y.perplexity_score(F.lit(float("nan")))) == 0.5
    assert value(spark, R.report_match_band(F.lit(70.0))) == "hi" and value(spark, R.match_class(F.lit(0.70))) == "med"
    assert value(spark, R.time_ago(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 02:30:00").cast("timestamp"))) == "2 jam lalu"


def test_confusion_of_nothing(spark):
    m = R.confusion(spark.createDataFrame([], "a boolean, d boolean"), "a", "d").first()
    assert (m.tp, m.precision, m.f1, m.accuracy) == (0, 0.0, 0.0, 0.0)


def docx(paras):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paras)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.DOCX_TEXT[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("Hello\n 12 \nworld", encoding="utf-8")
    (tmp_path / "sub" / "b.MD").write_bytes(b"caf\xc3\xa9 \xff bad")
    (tmp_path / "c.docx").write_bytes(docx(["First.", " ", "Second."]))
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "e.exe").write_bytes(b"MZ")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "Hello\nworld" and rows["c.docx"].text == "First.\nSecond." and rows["b.MD"].text.startswith("café")
    assert rows["d.docx"].error and "Unsupported file type" in rows["e.exe"].error
    corpus = {r.doc_id: r for r in files.load_corpus(spark, str(tmp_path)).collect()}
    assert set(corpus) == {"local:a.txt", "local:sub/b.MD", "local:c.docx"} and corpus["local:c.docx"].title == "c"


def test_atom(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/1</id><title>T\n one</title><summary>S  one</summary></entry><entry><id>http://x/abs/2</id><title></title><summary>S</summary></entry><entry><id>3</id><title>T</title><summary></summary></entry></feed>'
    d = spark.createDataFrame([(xml,)], "payload string")
    assert [(r.doc_id, r.text) for r in payloads.atom_entries(d).collect()] == [("arxiv:1", "S one"), ("arxiv:2", "S")]
    assert [r.text for r in payloads.atom_entries(d, need_title=True, with_title=True).collect()] == ["T one\n\nS one"]


def test_engine(spark, tmp_path):
    other = "Bread needs flour, water, salt and a little yeast, and a long slow rest in a warm place before it goes into a very hot oven."
    corpus = spark.createDataFrame([("a", BODY), ("b", other)], "doc_id string, text string")
    queries = spark.createDataFrame([("copy", BODY), ("quote", f"> {BODY}\nOwn words only"), ("new", "Completely different sentences about distant galaxies, dust and light observed with large telescopes at night."), ("empty", "")], "doc_id string, text string")
    engine = Engine(spark, corpus, Config(encoders=("hashed-words", "hashed-pairs")))
    result = engine.check(queries)
    scores = {r.doc_id: r for r in result.scores.collect()}
    assert scores["copy"].overall_score == 1.0 and scores["copy"].corpus_size == 2
    assert scores["quote"].flagged_paragraphs == scores["new"].flagged_paragraphs == scores["empty"].total_paragraphs == 0
    match = result.matches.collect()
    assert [(m.doc_id, m.chunk_id, m.kind, m["rank"]) for m in match] == [("copy", "a", "exact", 1)]
    assert "<mark>" in {r.doc_id: r.html for r in engine.report_html(result).collect()}["copy"]
    assert "[exact] 100.0 %" in {r.doc_id: r.report for r in sinks.text_reports(result.scores, result.matches, "doc_id").collect()}["copy"]
    shuffled = spark.createDataFrame([("s", " ".join(sorted(BODY.lower().replace(".", "").split())))], "doc_id string, text string")
    assert [m.kind for m in engine.check(shuffled, use_semantic=True).matches.collect()] == ["semantic"]
    PAIR_SCORERS["none"] = lambda a, b: F.lit(-1.0)
    strict = Engine(spark, corpus, Config(pair_scorer="none"))
    assert strict.check(shuffled, use_semantic=True, use_cross_encoder=True).matches.count() == 0
    del PAIR_SCORERS["none"]
    queries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    score_stream(engine, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_cache_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "one two"), (2, "three")], "id long, text string")
    made = hashed_bag(d, "id", "text")
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in made.collect())
    path = str(tmp_path / "cache")
    sinks.append_new(made.where("id = 1"), None, "id", path)
    assert [r.id for r in sinks.append_new(made, spark.read.parquet(path), "id", path).collect()] == [2]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    sinks.export_json(d, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_machine_text(spark):
    row = detect_machine_text(spark.createDataFrame([(1, BODY)], "id long, text string")).first()
    assert row.verdict == "MIXED" and row.ai_probability == 0.5


def test_page_lines():
    from textloom.functions.pages import page_lines

    page = "<h1>A &amp; B</h1>\n\n\n<p>one  two</p><script>x()</script><ul><li>a<br/>b</ul><section>c</section><a href='/q?x=1&amp;y'>here</a> <a href=plain>there</a><a name=z>no</a>&#8211;"
    assert page_lines(page) == "A & B\n\none two\na\nbc\n[/q?x=1&y] here \n[plain] thereno\u2013"


def test_references_and_composition(spark):
    page = "<p>caf&#233; e\u0301t&eacute; &mdash; &lt;b&gt; &#x1F600;</p><style>p{}</style>"
    assert value(spark, T.html_text(F.lit(page))) == "caf\u00e9 \u00e9t\u00e9 \u2014 <b> \U0001f600"


def test_references_cut_off(spark):
    """As in SQL, a reference without its semicolon stays, and so does an unknown name that begins like a known one."""
    page = "<p>a&amp b&ampc; d&lt e&amp;lt; f&#38 g&#38; h&copy;&</p>"
    assert value(spark, T.html_text(F.lit(page))) == "a&amp b&ampc; d&lt e&lt; f&#38 g& h\u00a9&"


def test_article_with_reference_cut_off(spark):
    page = F.lit("<title>Law &amp; order&amp</title><article>" + "word " * 50 + "this&amp</article>")
    assert value(spark, payloads.article_title(page)) == "Law & order&amp"
    assert value(spark, payloads.article_body(page)) == "word " * 50 + "this&amp"


def test_names_of_title_with_reference_cut_off(spark):
    title = payloads.article_title(F.lit("<title>der&&amp</title>"))
    assert value(spark, sinks.document_file(F.lit("arxiv"), title)) == "arxiv__der__amp.txt"


def test_upload_text(spark):
    df = spark.createDataFrame([(bytearray("gr\u00fcn".encode()),), (bytearray("gr\u00fcn".encode("latin-1")),)], "c binary")
    assert [r.t for r in df.select(files.upload_text(F.col("c")).alias("t")).collect()] == ["gr\u00fcn", "gr\u00fcn"]


def test_embedding_cache(spark, tmp_path):
    from textloom.operators import cache
    from textloom.operators.encoders import ENCODERS

    path, calls = str(tmp_path / "cache"), []

    def encode(rows, id_col, text_col):
        calls.append(rows.count())
        return ENCODERS["hashed-words"](rows, id_col, text_col)

    chunks = spark.createDataFrame([("a", "one two three"), ("b", "four five six")], "chunk_id string, text string")
    assert cache.prewarm(spark, path, {"m": encode, "n": encode}, chunks) == {"m": 2, "n": 2}
    more = chunks.unionByName(spark.createDataFrame([("c", "seven eight nine"), ("b", "changed text here")], "chunk_id string, text string"))
    assert cache.embeddings(spark, path, "m", more, encode).count() == 4 and cache.embeddings(spark, path, "m", chunks, encode).count() == 2
    assert calls == [2, 2, 2, 0]
    spark.createDataFrame([("k", [1.0])], "key string, embedding array<float>").write.mode("append").parquet(f"{path}/model=m")  # of another length
    assert cache.stored(spark, path, "m") is None and cache.embeddings(spark, path, "m", chunks, encode).count() == 2 and calls[-1] == 2
    cache.invalidate(spark, path, "n")
    assert cache.stored(spark, path, "n") is None


def test_measures(spark, tmp_path):
    df = spark.createDataFrame([("all", 0.5)], "name string, f1 double")
    sinks.write_measures(df, str(tmp_path))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()[0].f1 == "0.5" and spark.read.json(str(tmp_path / "json")).collect()[0].f1 == 0.5


def test_similar_pairs(spark):
    """All pairs of a threshold against plain sets, over several rounds; a common phrase in every text makes no candidates, copies and short texts stay."""
    import random

    rng, texts = random.Random(5), []
    for k in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 30, 60]))]
        texts += [" ".join(words), " ".join(words[: len(words) * 2 // 3] + [f"z{rng.randrange(99)}"]), " ".join(words)]
    texts = [t + " of the same old kind" * (i % 2) for i, t in enumerate(texts)] + ["one two", "One, two", "", None, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    runs = {}
    for i, t in enumerate(texts):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        runs[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    want = {(a, b): len(runs[a] & runs[b]) for a in runs for b in runs if a != b and 10 * len(runs[a] & runs[b]) >= 3 * len(runs[a] | runs[b]) > 0}
    before, S.ROUND_TEXTS, S.ROUND_PAIRS = (S.ROUND_TEXTS, S.ROUND_PAIRS), 40, 30
    try:
        got = {(r.a, r.b): r.common for r in S.similar_pairs(docs, "id", "text", 3, 10).collect()}
        best = {(r.a, r.b) for r in R.top_matches(S.similar_pairs(docs, "id", "text", 3, 10, best=2).select("a", "b", F.col("jaccard").alias("score")), 2, "a", ["b"]).collect()}
    finally:
        S.ROUND_TEXTS, S.ROUND_PAIRS = before
    assert got == want and len(want) > 100
    share = {(a, b): c / len(runs[a] | runs[b]) for (a, b), c in want.items()}
    assert best == {p for a in runs for p in sorted((p for p in share if p[0] == a), key=lambda p: (-share[p], p[1]))[:2]}


def test_similar_sets_in_one_pass(spark, monkeypatch):
    """More batches and blocks repeat no table: a search in rounds read all texts' shingles once a round. Near copies of one text, which meet at most of their shingles, are all paired."""
    import random

    from textloom.llm import storage

    rng, names, real = random.Random(8), [], storage.written
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(w if rng.random() > 0.06 else f"c{rng.randrange(9999)}" for w in [*base, f"own{i}"]) for i in range(40)]
    texts += [" ".join(f"u{rng.randrange(9999)}" for _ in range(50)) for _ in range(40)]
    runs = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    want = {(a, b, len(runs[a] & runs[b])) for a in range(80) for b in range(a + 1, 80) if 10 * len(runs[a] & runs[b]) >= 3 * len(runs[a] | runs[b])}
    monkeypatch.setattr(storage, "written", lambda df, name, *a, **k: (names.append(name), real(df, name, *a, **k))[1])
    monkeypatch.setattr(S, "ROUND_TEXTS", 9)
    monkeypatch.setattr(S, "ROUND_PAIRS", 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    _, links = S.similar_sets(docs, "id", "text", 3, 10)
    assert links.count() == len(want) > 500 and len(names) == len(set(names))
    assert {(r.a, r.b, r.common) for r in S.similar_pairs(docs, "id", "text", 3, 10, once=True).collect()} == want


def test_shingle_sets():
    """Hashes tell words and their number and order apart, at any length and whatever stands beside them."""
    import pyarrow as pa

    from textloom.operators import set_search

    words = ["", "a", "b", "ab", "abcdefgh", "abcdefghi", "abcdefg", "é" * 4, "x" * 64, "x" * 65, "x" * 66, "abcdefgh" * 2]
    h = set_search.word_hashes(pa.array(words))
    assert len(set(h.tolist())) == len(words) and (set_search.word_hashes(pa.array(words[::-1])) == h[::-1]).all()
    texts = ["a b c d", "d c b a", "a b", "b a", "a", "a a a", "a a a a a", "", None, "ab c", "a bc"]
    sets = set_search.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 1, 1, 0, 0, 1, 1]
    assert sets[5].tolist() == sets[6].tolist() and len({tuple(s.tolist()) for s in sets}) == 9


def test_best_partners_spare_links(spark):
    """Of a group of near copies, links that are nobody's best are dropped where they are made, ties with the last one kept; the best are those of all pairs."""
    import random

    rng = random.Random(9)
    texts = [" ".join(w if rng.random() > 0.05 else f"c{rng.randrange(9999)}" for w in [*(f"w{k}" for k in range(80)), f"own{i}"]) for i in range(50)]
    texts += [texts[3], texts[3], texts[7], " ".join(f"v{k}" for k in range(9)), *(" ".join([*(f"v{k}" for k in range(9)), f"tie{i}"]) for i in range(6))]
    runs = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    share = {(a, b): len(runs[a] & runs[b]) / len(runs[a] | runs[b]) for a in range(len(texts)) for b in range(len(texts)) if a != b}
    share = {p: s for p, s in share.items() if s >= 0.3}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = S.similar_pairs(docs, "id", "text", 3, 10, best=3)
    assert 150 < pairs.count() < len(share) / 3
    best = {(r.a, r.b) for r in R.top_matches(pairs.select("a", "b", F.col("jaccard").alias("score")), 3, "a", ["b"]).collect()}
    assert best == {p for a in range(len(texts)) for p in sorted((p for p in share if p[0] == a), key=lambda p: (-share[p], p[1]))[:3]}
