"""Registered queries, one per operator or group of operators. Their DuckDB equivalents are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import citations as C
from textloom.functions import style as Y
from textloom.functions import text as T
from textloom.functions.pages import linked_text
from textloom.operators import relational as R
from textloom.operators import similarity as S
from textloom.engine import Engine, paragraph_verdicts as judged
from textloom.operators.encoders import ENCODERS
from textloom.plans.inline import table
from textloom.sources import files, payloads, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
COUNTERS = ", ".join(C.STATS)


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt over all of them, as a row group can't be split."""
    df, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", "text")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, doc_id, chunk_no, text): chunk ids are doc_id * 1000000 + chunk_no."""
    d = docs(spark, folder).select("doc_id", F.posexplode(T.char_chunks(F.col("text"))).alias("chunk_no", "text"))
    return d.select((F.col("doc_id") * 1_000_000 + F.col("chunk_no")).alias("chunk_id"), "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text")


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "benchmark").select("item_id", "text")


def inline_and_docs(spark: SparkSession, folder: str, name: str = "texts") -> DataFrame:
    """Inline rows with negative ids, and all documents."""
    return table(spark, name).select((-F.col("id")).alias("id"), "text").unionByName(docs(spark, folder).withColumnRenamed("doc_id", "id"))


# --- text -----------------------------------------------------------------------------------------------------------


@query
def shingle_counts(spark, folder):
    counts = T.bound(T.words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(T.shingles(w)).cast("long").alias("n_shingles")))
    rows = inline_and_docs(spark, folder).select("id", F.size(T.blank_words(F.col("text"))).cast("long").alias("n_blank_words"), counts.alias("c"))
    return rows.select("id", "c.n_words", "n_blank_words", "c.n_shingles")


@query
def clean_text(spark, folder):
    return inline_and_docs(spark, folder).select("id", T.clean_lines(F.col("text")).alias("cleaned"))


@query
def paragraph_split(spark, folder):
    d = docs(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return T.split_paragraphs(d, min_chars=80, fallback=True).select("doc_id", F.col("para_no").cast("long").alias("para_no"), "para")


@query
def sentence_split(spark, folder):
    return inline_and_docs(spark, folder).select("id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence")).withColumn("sentence_no", F.col("sentence_no").cast("long"))


@query
def indonesian_flags(spark, folder):
    return inline_and_docs(spark, folder).select("id", T.looks_indonesian(F.col("text")).alias("looks"), T.roughly_indonesian(F.col("text")).alias("roughly"))


@query
def indonesian_preprocess(spark, folder):
    return inline_and_docs(spark, folder).select("id", F.array_join(T.indonesian_tokens(F.col("text")), " ").alias("tokens"), T.preprocess_indonesian(F.col("text")).alias("processed"))


@query
def doc_chunks(spark, folder):
    return chunks(spark, folder)


@query
def page_text(spark, folder):
    return read(spark, folder, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query
def page_articles(spark, folder):
    return read(spark, folder, "pages").select("page_id", payloads.article_title(F.col("html")).alias("title"), payloads.article_body(F.col("html")).alias("body"))


@query
def page_link_text(spark, folder):
    return read(spark, folder, "pages").select("page_id", linked_text(F.col("html")).alias("text"))


@query
def abstract_lines(spark, folder):
    head = F.concat(F.lit("Title\nAuthors\nAbstract: \n"), F.col("text"))
    return docs(spark, folder).select("doc_id", T.abstract_line(head).alias("abstract"), T.rewritten_abstract(head).alias("rewritten"), T.abstract_line(F.col("text")).alias("plain"))


@query
def highlighted_pairs(spark, folder):
    d = docs(spark, folder).alias("d").join(read(spark, folder, "benchmark").alias("b"), F.col("doc_id") == F.col("item_id"))
    both = table(spark, "pairs").select((-F.col("id")).alias("id"), "a", "b").unionByName(d.select(F.col("doc_id").alias("id"), F.col("d.text").alias("a"), F.col("b.text").alias("b")))
    return both.select("id", T.highlighted(F.col("a"), F.col("b")).alias("left_html"), T.highlighted(F.col("b"), F.col("a")).alias("right_html"))


@query
def file_names(spark, folder):
    n = F.col("name")
    return table(spark, "names").select("id", T.safe_title(n).alias("safe"), T.display_name(n).alias("display"), T.download_stem(T.display_name(n), F.lit("x")).alias("stem"), T.safe_ending(n).alias("ending"))


@query
def text_variants(spark, folder):
    return docs(spark, folder).select("doc_id", T.light_modified(F.col("text")).alias("light"), T.near_copy(F.col("text")).alias("near"))


@query
def paraphrases(spark, folder):
    return docs(spark, folder).select("doc_id", T.paraphrased(F.col("text")).alias("paraphrase"))


# --- citations and style --------------------------------------------------------------------------------------------


@query
def citation_strip_stats(spark, folder):
    out = C.strip_citations(inline_and_docs(spark, folder, "cited"))
    return out.select("id", "cleaned", F.round("reduction_pct", 6).alias("reduction_pct"), *[F.col(c).cast("long").alias(c) for c in C.STATS])


@query
def citation_sentences(spark, folder):
    return inline_and_docs(spark, folder, "cited").select("id", C.is_citation_sentence(F.col("text")).alias("cites"))


@query
def stylometry_features(spark, folder):
    d = Y.style_features(inline_and_docs(spark, folder))
    s = Y.style_score(F.col("sentence_length_std"), F.col("hedging_words_ratio"), F.col("ngram_repetition"), F.col("rare_word_ratio"))
    return d.select("id", *[F.round(c, 6).alias(c) for c in Y.FEATURES], F.round(s, 6).alias("style_score"))


@query
def machine_text_verdicts(spark, folder):
    p = Y.blended(F.col("p"), Y.perplexity_score(F.col("perplexity")), F.col("style"), F.col("n_words"))
    v, w = Y.verdict(p), Y.plain_verdict(F.col("p"))
    return table(spark, "probabilities").select("id", F.round(p, 6).alias("blend"), v["verdict"].alias("verdict"), v["confidence"].alias("confidence"), w["verdict"].alias("plain_verdict"), w["confidence"].alias("plain_confidence"))


# --- similarity -----------------------------------------------------------------------------------------------------


@query
def minhash_signatures(spark, folder):
    return S.signatures(docs(spark, folder), "doc_id", "text").select("doc_id", F.array_join("signature", ",").alias("signature"))


@query
def lsh_candidates(spark, folder):
    p = S.signatures(paragraphs(spark, folder), "item_id", "text")
    c = S.signatures(chunks(spark, folder), "chunk_id", "text")
    found = S.lsh_candidates(p, c, "item_id", "chunk_id")
    estimate = S.jaccard_estimate(F.col("p.signature"), F.col("c.signature"))
    return found.join(p.alias("p"), "item_id").join(c.alias("c"), "chunk_id").select("item_id", "chunk_id", estimate.alias("estimate"))


@query
def slot_candidates(spark, folder):
    p = S.signatures(paragraphs(spark, folder), "item_id", "text")
    c = S.signatures(chunks(spark, folder), "chunk_id", "text")
    return S.slot_candidates(p, c, "item_id", "chunk_id")


@query
def near_duplicate_pairs(spark, folder):
    pairs = S.similar_pairs(docs(spark, folder), "doc_id", "text", 3, 10, once=True)
    return pairs.select("a", "b", "common", F.round("jaccard", 9).alias("jaccard"))


@query
def exact_duplicates(spark, folder):
    by = docs(spark, folder).groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    return by.where("copies > 1")


@query
def chunk_windows(spark, folder):
    return S.text_windows(chunks(spark, folder), ["chunk_id"], "text").select("chunk_id", "win_no", "first", "last", F.md5(F.col("window").cast("binary")).alias("window_md5"))


def _benchmark_matches(spark, folder):
    p, c = paragraphs(spark, folder), chunks(spark, folder)
    sp, sc = S.signatures(p, "item_id", "text"), S.signatures(c, "chunk_id", "text")
    found = S.lsh_candidates(sp, sc, "item_id", "chunk_id").unionByName(S.slot_candidates(sp, sc, "item_id", "chunk_id").select("item_id", "chunk_id")).distinct()
    return S.windowed_matches(p, c, found, "item_id", "chunk_id")


@query
def benchmark_windowed_match(spark, folder):
    best = S.best_per(_benchmark_matches(spark, folder), "item_id", "score", "chunk_id")
    return best.select("item_id", "chunk_id", F.round("score", 9).alias("score"), S.match_kind(F.col("score")).alias("kind"), F.md5(F.col("window").cast("binary")).alias("window_md5"))


@query
def document_score(spark, folder):
    """Each document's paragraphs against the benchmark passages by exact Jaccard; the mean score of flagged ones, and bands."""
    d = docs(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    paras = T.split_paragraphs(d, min_chars=80, fallback=True).withColumn("para_id", F.col("doc_id") * 1_000_000 + F.col("para_no"))
    a = S.shingle_rows(paras, "para_id", "para")
    b = S.shingle_rows(paragraphs(spark, folder), "item_id", "text")
    best = S.best_per(S.jaccard_pairs(a, b, "para_id", "item_id", 0.3), "para_id", "jaccard", "item_id")
    matches = best.select(F.floor(F.col("para_id") / 1_000_000).alias("doc_id"), F.col("jaccard").alias("score"))
    out = R.document_scores(d, paras, matches, "doc_id")
    score = F.col("overall_score")
    return out.select("doc_id", "total_paragraphs", "flagged_paragraphs", F.round(score, 9).alias("overall_score"), R.risk_label(score).alias("risk_label"), R.risk_class(score).alias("risk_class"), R.suite_flag(F.col("flagged_paragraphs"), score).alias("suite_flag"), R.measured_flag(score, F.col("flagged_paragraphs")).alias("measured_flag"), R.comparison_flag(score).alias("comparison_flag"))


@query
def embedding_top1(spark, folder):
    e = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    top = S.cosine_top(e, e, "id", "embedding", same=True)
    return top.select("q", F.round("cosine", 5).alias("cosine"), (F.col("cosine") >= 0.75).alias("semantic"))


@query
def embedding_ensemble(spark, folder):
    """Three models: all components, the first half, and the second half."""
    e = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    parts = [e, e.withColumn("embedding", F.slice("embedding", 1, 32)), e.withColumn("embedding", F.slice("embedding", 33, 32))]
    votes = S.ensemble_vote([S.cosine_top(p, p, "id", "embedding", same=True) for p in parts])
    return votes.select("q", "c", "votes", F.round("score", 5).alias("score"))


@query
def semantic_fallback(spark, folder):
    """Passages without a near match."""
    near = _benchmark_matches(spark, folder)
    return paragraphs(spark, folder).join(near, "item_id", "left_anti").select("item_id")


@query
def semantic_matches(spark, folder):
    """The best near match of each passage; for those without one, the most similar chunk by the default encoder, where its cosine is 0.75 or more."""
    best = S.best_per(_benchmark_matches(spark, folder), "item_id", "score", "chunk_id")
    left = paragraphs(spark, folder).join(best, "item_id", "left_anti").select("item_id", "text")
    encode = ENCODERS["hashed-words"]
    asked = encode(left, "item_id", "text").withColumnRenamed("item_id", "id")
    known = encode(chunks(spark, folder), "chunk_id", "text").withColumnRenamed("chunk_id", "id")
    top = S.cosine_top(asked, known, "id", "embedding").where("cosine >= 0.75")
    more = top.select(F.col("q").alias("item_id"), F.col("c").alias("chunk_id"), F.round("cosine", 6).alias("score"), F.lit("semantic").alias("kind"))
    return best.select("item_id", "chunk_id", F.round("score", 6).alias("score"), S.match_kind(F.col("score")).alias("kind")).unionByName(more)


@query
def engine_check(spark, folder):
    """Documents (lines as paragraphs) checked end to end against the benchmark passages: quotations and citations out, candidates, windows, best match a paragraph, scores."""
    d = docs(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    corpus = paragraphs(spark, folder).select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("source"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"))
    scores = Engine(spark, corpus).check(d).scores
    return scores.select("doc_id", "total_paragraphs", "flagged_paragraphs", F.round("overall_score", 9).alias("overall_score"), "corpus_size")


@query
def paragraph_verdicts(spark, folder):
    """Lines of 100 characters or more, judged by a stand-in for a classifier: their length modulo 101."""
    d = docs(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return judged(d, lambda text: F.length(text) % 101 / 101)


@query
def rerank(spark, folder):
    return S.reranked(table(spark, "logits")).select("para", "kind", F.round("score", 9).alias("score"))


# --- aggregates and statistics --------------------------------------------------------------------------------------


def _cases(spark, folder):
    d = docs(spark, folder).join(read(spark, folder, "labels"), "doc_id").join(read(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return d.select("lang", (F.col("quality") == 1).alias("actual"), (F.regexp_count("text", F.lit("[#*$%&|]")) < 5).alias("detected"))


MEASURES = ["precision", "recall", "specificity", "fpr", "f1", "accuracy"]


@query
def confusion_matrix(spark, folder):
    m = R.confusion(_cases(spark, folder), "actual", "detected")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in MEASURES])


@query
def confusion_by_language(spark, folder):
    m = R.confusion(_cases(spark, folder), "actual", "detected", ["lang"])
    return m.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in MEASURES])


@query
def corpus_stats(spark, folder):
    d = read(spark, folder, "documents").select("source", F.size(T.words(F.col("text"))).cast("long").alias("words"), F.octet_length("text").cast("long").alias("bytes"), T.roughly_indonesian(F.col("text")).alias("i"))
    by = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.sum("bytes").alias("bytes"), F.count_if("i").alias("indonesian"))
    shares = R.share_by(d, "source").select("source", F.round("percent", 9).alias("percent"))
    return by.join(shares, "source").select("source", "n", "words", "bytes", "indonesian", "percent", F.expr("words div n").alias("avg_words"))


@query
def file_sources(spark, folder):
    return R.share_by(table(spark, "files").select(R.file_source(F.col("name")).alias("source")), "source").select("source", "n", F.round("percent", 9).alias("percent"))


@query
def term_stats(spark, folder):
    w = docs(spark, folder).select("doc_id", F.explode(T.words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("c"))
    return w.groupBy("doc_id").agg(F.sum("c").alias("words"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("c") == 1).alias("hapaxes"), F.max("c").alias("most"))


# --- sets and increments --------------------------------------------------------------------------------------------


@query
def first_wins_union(spark, folder):
    return R.first_wins([table(spark, "listing")], "doc_id", ["query_no", "source_no", "place"]).select("doc_id", "title", "query_no", "source_no")


@query
def append_documents(spark, folder):
    seed = spark.createDataFrame([(-1, "A seeded document. A seeded document.")], "doc_id long, text string")
    both = docs(spark, folder).unionByName(seed).unionByName(seed)
    return both.groupBy(F.length("text").alias("chars")).agg(F.count(F.lit(1)).alias("n")).withColumn("chars", F.col("chars").cast("long"))


@query
def shingle_sets(spark, folder):
    p = paragraphs(spark, folder).join(docs(spark, folder).withColumnRenamed("text", "other"), F.col("item_id") == F.col("doc_id"))
    a, b = T.shingles(T.words(F.col("text"))), T.shingles(T.words(F.col("other")))
    return p.select("item_id", F.size(F.array_intersect(a, b)).cast("long").alias("common"), F.size(F.array_union(a, b)).cast("long").alias("all_of_both"))


@query
def link_list(spark, folder):
    return payloads.article_links(table(spark, "links"))


@query
def round_robin(spark, folder):
    return R.round_robin(table(spark, "journals"), "subject", "place", "subject").select("subject", "journal", F.col("turn").cast("long").alias("turn"))


@query
def not_collected(spark, folder):
    pages = read(spark, folder, "pages").select("page_id", "url")
    seen = pages.where("page_id % 3 = 0").select(R.collected_key(F.col("url")).alias("key"))
    return R.not_collected(pages, seen).select("page_id", "key")


@query
def cache_delta(spark, folder):
    """A cache of the even vectors and one that is gone; the odd ones are missing and are encoded (here: by their label)."""
    e = read(spark, folder, "embeddings").select("vec_id", F.col("label").cast("long").alias("value"))
    cached = e.where("vec_id % 2 = 0").unionByName(spark.createDataFrame([(-5, 1)], "vec_id long, value long"))
    return R.merged_cache(e, cached, "vec_id", lambda m: m.withColumn("value", F.col("value") + 1000)).select("vec_id", "value")


@query
def cache_keys(spark, folder):
    return chunks(spark, folder).select("chunk_id", R.cache_key(F.col("chunk_id"), F.col("text")).alias("key"))


# --- reports --------------------------------------------------------------------------------------------------------


def _reports(spark, folder):
    """Events as reports: the user is the session, the value makes the score."""
    e = read(spark, folder, "events")
    name = F.when(F.col("event_id") % 17 == 0, "?").otherwise(F.concat(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("string"), F.lit("_abcd1234_"), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"), F.lit(".docx")))
    return e.select(
        F.col("event_id").alias("report_id"), F.col("user_id").cast("string").alias("session"), name.alias("document_name"), (F.col("event_id") % 5).alias("total_paragraphs"),
        ((F.col("event_id") % 101) / 100).alias("overall_score"), (F.col("event_id") % 97).cast("double").alias("ai_percent"), F.col("ts").alias("finished_at"),
    )


@query
def recent_reports(spark, folder):
    return R.recent_reports(_reports(spark, folder), "7", 20).select("report_id", "document_name", "overall_score", "finished_at")


@query
def report_lookup(spark, folder):
    r = _reports(spark, folder)
    return R.find_report(r, 42, "7").unionByName(r.where("report_id = 42")).select("report_id", "session")


@query
def enriched_reports(spark, folder):
    s, ai = F.col("overall_score"), F.col("ai_percent")
    return _reports(spark, folder).select(
        "report_id", T.display_name(F.col("document_name")).alias("display"), R.risk_label(s).alias("label"), R.risk_class(s).alias("risk"), R.match_class(s).alias("match"), R.ai_class(ai).alias("ai"),
        R.report_document_band(s * 100).alias("document_band"), R.report_match_band(s * 100).alias("match_band"), R.indonesian_time(F.col("finished_at")).alias("finished"), R.time_ago(F.col("finished_at"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("ago"),
    )


@query
def history_search(spark, folder):
    return R.history(_reports(spark, folder), "CLICK", "high", "highest").select("report_id", "document_name", "overall_score")


@query
def history_machine_text(spark, folder):
    return R.history(_reports(spark, folder), "", "ai", "oldest").select("report_id", "ai_percent")


@query
def report_retention(spark, folder):
    named = _reports(spark, folder).select("report_id", F.col("document_name").alias("name"), F.length("document_name").cast("long").alias("bytes"))
    marked = R.retention(named, F.lit(1706745600000), 10)
    return marked.groupBy("expired").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / 1048576, 6).alias("mb"))


@query
def session_ids(spark, folder):
    return table(spark, "sessions").select("sid", R.session_ok(F.col("sid")).alias("ok"), R.session_prefix(F.col("sid")).alias("prefix"))


@query
def ranked_matches(spark, folder):
    pairs = S.similar_pairs(docs(spark, folder), "doc_id", "text", 3, 10, best=3)
    top = R.top_matches(pairs.select("a", "b", F.col("jaccard").alias("score")), 3, "a", ["b"])
    return top.select("a", "b", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query
def semantic_scholar_rows(spark, folder):
    return payloads.semantic_scholar(table(spark, "scholar")).withColumn("year", F.col("year").cast("long"))


@query
def open_alex_rows(spark, folder):
    return payloads.open_alex(table(spark, "alex"))


@query
def crossref_rows(spark, folder):
    return payloads.crossref(table(spark, "cross")).withColumn("year", F.col("year").cast("long"))


@query
def abstract_service_rows(spark, folder):
    return payloads.abstracts_service(table(spark, "abstracts"))


@query
def sitemap_links(spark, folder):
    return payloads.sitemap_links(table(spark, "sitemaps")).withColumn("place", F.col("place").cast("long"))


@query
def journal_articles(spark, folder):
    html = F.col("html")
    d = table(spark, "journal_pages").select("id", payloads.article_metadata(html).alias("m"), F.array_join(payloads.linked_ids(html, "/journal/view").cast("array<string>"), ",").alias("journals"))
    return d.select("id", "m.title", F.array_join("m.authors", "|").alias("authors"), "m.abstract", "m.journal", "m.volume_issue", "m.publish_date", "m.subject", "journals")


@query
def upload_checks(spark, folder):
    return table(spark, "uploads").select("name", "length", files.upload_problem(F.col("name"), F.col("length"), F.col("head").cast("binary")).alias("problem"))


@query
def stored_names(spark, folder):
    d = read(spark, folder, "pages").select("page_id", "url", payloads.article_title(F.col("html")).alias("title"))
    t, u = F.col("title"), F.col("url")
    return d.select("page_id", sinks.document_file(F.lit("arxiv"), t).alias("document"), sinks.abstract_file(F.lit("Law & Order"), t, F.col("page_id")).alias("abstract"), sinks.news_file(F.lit("detik"), u).alias("news"), sinks.news_content(t, F.lit("body"), u).alias("content"))
