"""Every registered query of the library against its DuckDB equivalent, on the smallest tables."""

import math
import os

import duckdb
import pytest

from textloom.plans.oracles import ORACLES
from textloom.plans.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6))
    return str(x)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())
    assert got == want


def test_semantic_matches(spark):
    """Passages that no chunk resembles in words' order but one does in words come from the encoder, with the chunk of the largest cosine."""
    from textloom.operators import similarity as S
    from textloom.operators.encoders import ENCODERS

    import numpy as np

    texts = {1: "alpha beta gamma delta epsilon zeta", 2: "river mill road town valley hills", 3: "zeta epsilon delta gamma beta alpha"}
    frames = [spark.createDataFrame(list(x.items()), "id long, text string") for x in ({10: texts[3], 11: "town road hills valley mill river stone"}, texts)]
    asked, known = (ENCODERS["hashed-words"](d, "id", "text") for d in frames)
    a, k = ({r.id: np.array(r.embedding, float) for r in d.collect()} for d in (asked, known))
    got = {r.q: (r.c, round(r.cosine, 5)) for r in S.cosine_top(asked, known, "id", "embedding").collect()}
    want = {q: max(((float(v @ w), -c) for c, w in k.items())) for q, v in a.items()}
    assert {q: got[q][1] for q in got} == {q: round(x[0], 5) for q, x in want.items()} and got[11][0] == 2 and got[10][0] in (1, 3)


def test_engine_check(spark):
    """The registered check against its parts on a few documents: citations out, lines as paragraphs, every passage's windows compared whole."""
    from textloom.engine import Engine

    corpus = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)), "benchmark", "one")], "doc_id long, text string, source string, title string")
    same, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"x{k}" for k in range(40))
    docs = spark.createDataFrame([(5, f"{same}\n\n{other} (Smith, 2020)"), (6, other), (7, None)], "doc_id long, text string")
    result = Engine(spark, corpus).check(docs.where("text is not null"))
    scores = {r.doc_id: (r.total_paragraphs, r.flagged_paragraphs, r.corpus_size) for r in result.scores.collect()}
    assert scores == {5: (2, 1, 1), 6: (1, 0, 1)}
    (match,) = result.matches.collect()
    assert (match.source_title, match.source_url, match.source_type) == ("one", "", match.kind) and "<mark>w1</mark>" not in match.preview_html and match.preview_html.startswith("<p>w0")
