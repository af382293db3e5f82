"""Sinks: corpora, results and reports as tables, JSON lines, HTML and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import escape_html, highlighted, safe_title
from textloom.operators.relational import collected_key, report_document_band, report_match_band


def export_json(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").json(path)


def write_measures(measures: DataFrame, path: str) -> None:
    """A table of measures as CSV with a header and as JSON lines, each in a folder of its own."""
    measures.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    measures.write.mode("overwrite").json(f"{path}/json")


def append_new(rows: DataFrame, stored: DataFrame | None, key: str, path: str) -> DataFrame:
    """Append the rows whose key is not stored yet; returns them."""
    new = rows.join(stored.select(key), key, "left_anti") if stored is not None else rows
    new.write.mode("append").parquet(path)
    return new


def document_file(source: Column, title: Column) -> Column:
    return F.concat(source, F.lit("__"), safe_title(title), F.lit(".txt"))


def abstract_file(subject: Column, title: Column, doc_id: Column) -> Column:
    digest = F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit("-"), title).cast("binary")), 1, 10)
    return F.concat(F.lit("garuda__"), safe_title(subject), F.lit("__"), safe_title(title), F.lit("_"), digest, F.lit(".txt"))


def news_file(site: Column, url: Column) -> Column:
    return F.concat(F.lit("news_"), site, F.lit("_"), collected_key(url), F.lit(".txt"))


def news_content(title: Column, body: Column, url: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), body, F.lit("\n\nSource: "), url, F.lit("\n"))


def html_reports(scores: DataFrame, matches: DataFrame, doc_id: str, limit: int = 100) -> DataFrame:
    """(doc_id, html): one page a document, with at most ``limit`` matches, best first.

    ``matches`` has doc_id, rank, score, kind, query_text, matched_text and source_title.
    """
    percent = F.round(F.col("score") * 100, 1)
    pair = F.concat(F.lit("<div class='pair'><p>"), highlighted(F.col("query_text"), F.col("matched_text")), F.lit("</p><p>"), highlighted(F.col("matched_text"), F.col("query_text")), F.lit("</p></div>"))
    one = F.concat(F.lit("<section class='"), report_match_band(percent), F.lit("'><h2>"), escape_html(F.col("source_title")), F.lit(" ("), F.col("kind"), F.lit(", "), percent.cast("string"), F.lit(" %)</h2>"), pair, F.lit("</section>"))
    parts = matches.where(F.col("rank") <= limit).groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("h")))).alias("_m"))
    whole = F.round(F.col("overall_score") * 100, 1)
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'></head><body><h1 class='"), report_document_band(whole), F.lit("'>"), escape_html(F.col(doc_id).cast("string")), F.lit(": "), whole.cast("string"), F.lit(" %</h1>"),
        F.array_join(F.transform(F.coalesce("_m", F.array().cast("array<struct<rank:int,h:string>>")), lambda x: x["h"]), ""), F.lit("</body></html>"),
    )
    return scores.join(parts, doc_id, "left").select(doc_id, page.alias("html"))


def text_reports(scores: DataFrame, matches: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, report): the same in plain text, with all matches."""
    one = F.format_string("%d. [%s] %.1f %% %s", "rank", "kind", F.col("score") * 100, "source_title")
    parts = matches.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("l")))).alias("_m"))
    head = F.format_string("Document %s\nOverall score: %.1f %%\nParagraphs: %d, flagged: %d\n", F.col(doc_id).cast("string"), F.col("overall_score") * 100, "total_paragraphs", "flagged_paragraphs")
    lines = F.coalesce(F.array_join(F.transform("_m", lambda x: x["l"]), "\n"), F.lit("No matches."))
    return scores.join(parts, doc_id, "left").select(doc_id, F.concat(head, lines).alias("report"))
