"""The pipeline's near-dedup stage against all pairs compared, by fingerprint and by shingles."""

import itertools
import random
import re

import numpy as np
import xxhash

from corpus_pipeline import COLUMNS, near_duplicates
from textloom.llm import shingle_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 5]).encode(), 42) for k in range(max(1, len(w) - 4))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def kept(docs):
    sets, up = [grams(t) for _, t in docs], list(range(len(docs)))
    prints = [fingerprint(t) for _, t in docs]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4 or sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    least = {}
    for k, (i, _) in enumerate(docs):
        r = root(k)
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return sorted(str(None if z else i) for z, i in least.values())


def test_copies_around_the_threshold(spark):
    """Near copies with ever more words changed, from Jaccard 1 down past 0.8, and ties at exactly 0.8."""
    rng, docs = random.Random(4), []
    for base in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(100 + 30 * base)]
        for changes in range(8):
            copy = words.copy()
            for k in rng.sample(range(len(copy)), changes):
                copy[k] = f"c{rng.randrange(5000)}"
            docs.append(" ".join(copy))
    line = [f"t{k}" for k in range(24)]
    docs += [" ".join(line[:20]), " ".join(line), " ".join([*line[:20], "other"] * 2)]
    docs = [(i, t) for i, t in enumerate(rng.sample(docs, len(docs)))]
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(str(r.doc_id) for r in near_duplicates(spark, table, "").collect())
    assert got == kept(docs) and 6 < len(got) < len(docs) - 6


def test_odd_rows(spark, odd_docs):
    got = near_duplicates(spark, odd_docs.select(*COLUMNS), "")
    assert sorted(str(r.doc_id) for r in got.collect()) == kept([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = near_duplicates(spark, docs, "").select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == kept([(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_link_below_the_similarity(spark):
    """Two texts whose fingerprints are within the radius are one class although too few shingles are the same."""
    rng, found = random.Random(5), None
    while found is None:
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        copy = [w if k not in (15, 30, 45) else "other" for k, w in enumerate(words)]
        a, b = " ".join(words), " ".join(copy)
        if (fingerprint(a) ^ fingerprint(b)).bit_count() <= 4:
            found = [(0, a), (1, b), (2, "quite another text of some few words")]
    assert len(grams(found[0][1]) & grams(found[1][1])) < 0.8 * len(grams(found[0][1]) | grams(found[1][1]))
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in found], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in near_duplicates(spark, table, "").collect()) == [0, 2]


def test_rows_are_dealt_out_once(spark):
    """The kept rows are joined and their copies dropped behind one exchange of texts; a second one took as much disk again."""
    from pyspark.sql import functions as F

    from textloom.llm.simhash_dedup import row_key, rows_of

    rows = [(1, "a", "x"), (1, "a", "y"), (None, "b", "z"), (None, "b", "w"), (2, None, "q"), (3, "c", None), (None, None, "p"), (1, "d", "k"), (4, "e", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = docs.where("doc_id is null or doc_id < 4").groupBy("doc_id", row_key("text").alias("of")).count().select(F.col("doc_id").alias("id"), "of")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rows_of(docs, kept, "doc_id", "text")
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple").split("Initial Plan")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted({(i, t) for i, t, _ in rows if i != 4}, key=str)
    assert plan.count("Exchange") == 3  # of texts; of kept keys, and of their own grouping


def test_near_duplicates_leave_little(spark, tmp_path, monkeypatch):
    """Heads and maps of sets are deleted before the texts that stay are moved."""
    monkeypatch.setattr("textloom.llm.storage.shared_folder", lambda spark: f"file://{tmp_path}")
    rows = [(i, f"one two three four five six {i // 2}", "en", "s", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = near_duplicates(spark, docs, "")
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "textloom").iterdir()}
    assert "shingle-kept" in left and not left & {"shingle-rows", "shingle-nodes", "shingle-pairs", "shingle-texts"}
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


def test_wide_maps_spare_texts():
    """Long texts fill the narrow maps, which then rule out next to nothing; the wide ones do, and never a pair that links."""
    rng = np.random.default_rng(5)
    hashes = rng.integers(1, 1 << 63, 20000).astype(np.uint64)
    for common, links in ((1500, False), (1700, False), (1778, True), (1900, True), (2000, True)):
        a, b = np.sort(hashes[:2000]), np.sort(np.concatenate([hashes[:common], hashes[5000 : 7000 - common]]))
        narrow = [np.frombuffer(shingle_dedup.bit_map(s), np.uint8) for s in (a, b)]
        assert 9 * (2000 - int(np.bitwise_count(narrow[0] & ~narrow[1]).sum())) >= 4 * 4000
        wide = shingle_dedup.most_common(2000, 2000, shingle_dedup.wide_map(a), shingle_dedup.wide_map(b))
        assert wide >= common and (9 * wide >= 4 * 4000) == links
    for n, m in ((0, 0), (1, 1), (128, 129), (1000, 1100), (300, 2000)):  # maps of unlike sizes are folded
        a, b = np.sort(hashes[:n]), np.sort(hashes[:m])
        assert min(n, m) <= shingle_dedup.most_common(n, m, shingle_dedup.wide_map(a), shingle_dedup.wide_map(b))


def test_near_copies_cost_no_square(spark):
    """Sets in one class already are not paired; sets of other classes are, all of them."""
    head = [(k, 10, list(range(100, 103)), 1 if k < 40 else k) for k in range(60)]
    nodes = spark.createDataFrame(head, "_set long, _size int, _head array<long>, _class long")
    assert shingle_dedup.first_candidates(nodes, 4, 5).count() == 59
    got = {(r.x, r.y) for r in shingle_dedup.candidates(nodes, 4, 5).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(60), 2) if b >= 40}
