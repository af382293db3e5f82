"""The check of documents against a corpus: from texts to matches and scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.citations import strip_citations
from textloom.functions.style import blended, perplexity_score, plain_verdict, style_features, style_score, verdict
from textloom.functions.text import INDONESIAN_STOPWORDS, char_chunks, preprocess_indonesian, highlighted, split_paragraphs, trimmed
from textloom.operators import similarity as S
from textloom.operators.encoders import CLASSIFIERS, ENCODERS, PAIR_SCORERS, PERPLEXITIES
from textloom.operators.relational import document_scores, top_matches
from textloom.sources.sinks import html_reports


@dataclass(frozen=True)
class Config:
    near_threshold: float = 0.30
    semantic_threshold: float = 0.75
    cross_encoder_threshold: float = 0.5
    encoders: tuple[str, ...] = ("hashed-words",)
    pair_scorer: str | None = None
    query_preprocess: bool = False
    stopwords: Sequence[str] = tuple(INDONESIAN_STOPWORDS)
    chunk_chars: int = 1500
    chunk_stride: int = 1300


# Named settings of a check.
PRESETS = {
    "cepat": {"use_semantic": False, "use_cross_encoder": False},
    "standar": {"use_semantic": True, "use_cross_encoder": False},
    "akurat": {"use_semantic": True, "use_cross_encoder": True},
}


def chunk(corpus: DataFrame, id_col: str = "doc_id", size: int = 1500, stride: int = 1300) -> DataFrame:
    """(chunk_id, parent_id, chunk_no, n_chunks, text, other columns): chunk ids are the parent's where it has one chunk only."""
    d = corpus.withColumn("_c", char_chunks(F.col("text"), size, stride)).withColumn("n_chunks", F.size("_c"))
    d = d.select(*[c for c in corpus.columns if c not in ("text", id_col)], F.col(id_col).alias("parent_id"), "n_chunks", F.posexplode("_c").alias("chunk_no", "text"))
    plain = F.col("parent_id").cast("string")
    return d.withColumn("chunk_id", F.when(F.col("n_chunks") == 1, plain).otherwise(F.concat(plain, F.lit("#chunk"), F.col("chunk_no").cast("string"))))


@dataclass
class Result:
    """Frames of one check: scores (a row a document), matches (a row a flagged paragraph), stats (a row a document)."""

    scores: DataFrame
    matches: DataFrame
    stats: DataFrame


class Engine:
    """Checks batches of documents against ``corpus`` (doc_id, text, and what else it has)."""

    def __init__(self, spark: SparkSession, corpus: DataFrame, config: Config | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.chunks = chunk(corpus.select("doc_id", "text", *[c for c in ("title", "url", "source") if c in corpus.columns]), "doc_id", self.config.chunk_chars, self.config.chunk_stride)

    def candidates(self, paras: DataFrame) -> DataFrame:
        """Pairs that share an LSH band, or agree in 27 of 128 slots."""
        p = S.signatures(paras, "para_id", "text")
        c = S.signatures(self.chunks, "chunk_id", "text")
        return S.lsh_candidates(p, c, "para_id", "chunk_id").unionByName(S.slot_candidates(p, c, "para_id", "chunk_id").select("para_id", "chunk_id")).distinct()

    def semantic(self, paras: DataFrame, ensemble: bool) -> DataFrame:
        """(para_id, chunk_id, score, kind) of the most similar chunk, where that is similar enough."""
        names = self.config.encoders if ensemble else self.config.encoders[:1]
        keyed = self.chunks.select("chunk_id", "text", F.xxhash64("chunk_id").alias("c"))
        asked = paras.select("para_id", "text", F.xxhash64("para_id").alias("q"))
        tops = [S.cosine_top(ENCODERS[n](asked, "q", "text").withColumnRenamed("q", "id"), ENCODERS[n](keyed, "c", "text").withColumnRenamed("c", "id"), "id", "embedding") for n in names]
        best = S.ensemble_vote(tops) if ensemble and len(tops) > 1 else tops[0].withColumn("score", F.col("cosine"))
        best = best.where(F.col("score") >= self.config.semantic_threshold)
        kind = "ensemble" if ensemble and len(tops) > 1 else "semantic"
        return best.join(asked.select("q", "para_id"), "q").join(keyed.select("c", "chunk_id"), "c").select("para_id", "chunk_id", "score", F.lit(kind).alias("kind"))

    def check(self, docs: DataFrame, top_k: int = 5, use_semantic: bool = False, use_cross_encoder: bool = False, strip: bool = True, min_paragraph_chars: int = 80, use_ensemble: bool = False) -> Result:
        """``docs`` has doc_id and text; every document gets a row of scores."""
        stats = strip_citations(docs.select("doc_id", "text")) if strip else docs.select("doc_id", F.col("text").alias("cleaned"))
        cleaned = stats.select("doc_id", F.col("cleaned").alias("text"))
        if self.config.query_preprocess:
            cleaned = cleaned.withColumn("text", preprocess_indonesian(F.col("text"), self.config.stopwords))
        paras = split_paragraphs(cleaned, min_chars=min_paragraph_chars, fallback=True)
        paras = paras.select("doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("para_no").cast("string")).alias("para_id"), F.col("para").alias("text"))
        near = S.windowed_matches(paras, self.chunks, self.candidates(paras), "para_id", "chunk_id", self.config.near_threshold)
        best = S.best_per(near, "para_id", "score", "chunk_id").select("para_id", "chunk_id", "score", S.match_kind(F.col("score")).alias("kind"), F.col("window").alias("matched_text"))
        if use_semantic or use_ensemble:
            left = paras.join(best.select("para_id"), "para_id", "left_anti")
            more = self.semantic(left, use_ensemble).join(self.chunks.select("chunk_id", F.col("text").alias("matched_text")), "chunk_id")
            best = best.unionByName(more)
        named = best.join(paras.select("para_id", "doc_id", F.col("text").alias("query_text")), "para_id")
        title = F.col("title") if "title" in self.chunks.columns else F.col("parent_id").cast("string")
        told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in self.chunks.columns else F.lit("")
        matches = named.join(self.chunks.select("chunk_id", "parent_id", title.alias("source_title"), told("url").alias("source_url")), "chunk_id")
        shown = F.concat(F.lit("<p>"), highlighted(F.col("query_text"), F.col("matched_text")), F.lit("</p><p>"), highlighted(F.col("matched_text"), F.col("query_text")), F.lit("</p>"))
        matches = matches.withColumn("preview_html", shown)
        if use_cross_encoder and self.config.pair_scorer:
            logit = PAIR_SCORERS[self.config.pair_scorer](F.col("query_text"), F.col("matched_text"))
            matches = S.reranked(matches.withColumn("logit", logit), "logit", self.config.cross_encoder_threshold)
        scores = document_scores(docs, paras, matches, "doc_id").crossJoin(F.broadcast(self.chunks.agg(F.count(F.lit(1)).alias("corpus_size"))))
        # What kind of match it is; re-ranking may have changed it.
        matches = matches.withColumn("source_type", F.col("kind"))
        ranked = top_matches(matches, 1 << 30, "doc_id", ["para_id"]).join(scores.select("doc_id", "total_paragraphs"), "doc_id")
        return Result(scores, ranked.where(F.col("rank") <= top_k * F.col("total_paragraphs")).drop("total_paragraphs"), stats)

    def report_html(self, result: Result) -> DataFrame:
        return html_reports(result.scores, result.matches, "doc_id")


def detect_machine_text(docs: DataFrame, classifier: str = "none", perplexity: str = "none") -> DataFrame:
    """``docs`` with ai_probability, verdict and confidence from style and the named models."""
    text = F.substring("text", 1, 2000)
    d = style_features(docs)
    style = style_score(F.col("sentence_length_std"), F.col("hedging_words_ratio"), F.col("ngram_repetition"), F.col("rare_word_ratio"))
    n = F.size(F.split(F.trim("text"), r"\s+"))
    p = blended(CLASSIFIERS[classifier](text), perplexity_score(PERPLEXITIES[perplexity](text)), style, n)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return d.withColumn("_p", p).withColumn("ai_probability", F.round("_p", 3)).withColumn("_v", verdict(F.col("_p"))).select("*", "_v.verdict", "_v.confidence").drop("_p", "_v")


def paragraph_verdicts(docs: DataFrame, classify, min_chars: int = 100) -> DataFrame:
    """(doc_id, para_no, text, ai_probability, verdict) of paragraphs of ``min_chars`` characters or more, judged by their first 1000; ``classify`` takes a text column to a probability."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("para_no", "para")).withColumn("para", trimmed(F.col("para")))
    parts = parts.where(F.length("para") >= min_chars).withColumn("p", classify(F.substring("para", 1, 1000)))
    return parts.select("doc_id", F.col("para_no").cast("long").alias("para_no"), F.concat(F.substring("para", 1, 200), F.lit("...")).alias("text"), F.round("p", 3).alias("ai_probability"), plain_verdict(F.col("p"))["verdict"].alias("verdict"))
