"""Stripping of quotations and citations, in a fixed order of steps; each step counts on what the one before left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trimmed

# Patterns of what is stripped. Names, years and pages of inline citations come from the same parts.
_NAME = r"[A-Z][A-Za-z\-']+"
_YEAR = r"\d{4}[a-z]?"
_PAGE = r"(?:[,:]?\s*(?:p\.|pp\.|hal\.?|h\.)\s*\d+(?:[-–]\d+)?)?"
_FIRST = rf"(?:{_NAME}(?:(?:\s*(?:&|and|dan)\s*|,\s*){_NAME})*(?:,?\s*et\s+al\.?)?)(?:,?\s*)?(?:{_YEAR}){_PAGE}"
_NEXT = rf"(?:\s*[;,]\s*(?:{_NAME}(?:\s+(?:&|and|dan)\s+{_NAME})*(?:\s+et\s+al\.?)?,?\s*{_YEAR}{_PAGE}))*"
INLINE = rf"\({_FIRST}{_NEXT}\)"
BLOCK_QUOTE = r"^\s*>.*$"
BIBLIOGRAPHY = r"^\s*(references?|bibliography|daftar\s+pustaka|dapus|bibliografi|pustaka)\s*[:\-]?\s*$"
DOUBLE_QUOTE = r"[\"“](.+?)[\"”]"
SINGLE_QUOTE = r"‘(.+?)’"
FOOTNOTE = r"\[\s*\d+\s*\]|\[\s*[A-Z][A-Za-z]+\s*\]"
URL = r"https?://\S+|doi\.org/\S+|doi:\s*\S+"
NUMBERED = r"^\s*\[\d+\]\s+[A-Z]|\s+\d+\.\s+[A-Z][a-z]+,\s+[A-Z]\."
PHRASE = r"according to|menurut|disampaikan oleh|as stated by|as reported by|sebagaimana dikemukakan oleh|in the work of|dalam karya"

#: The counters of a stripped text, in order.
STATS = ["original_chars", "block_quotes_stripped", "bibliography_chars_stripped", "direct_quotes_stripped", "inline_citations_stripped", "footnote_refs_stripped", "urls_stripped", "cleaned_chars"]


def strip_citations(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``cleaned`` and the counters (int), and ``reduction_pct``: the share of characters gone, in percent."""
    d = docs.withColumn("original_chars", F.length(text_col)).withColumn("cleaned", F.col(text_col))

    def strip(d: DataFrame, flags: str, pattern: str, count: str) -> DataFrame:
        full = f"{flags}{pattern}"
        return d.withColumn(count, F.regexp_count("cleaned", F.lit(full))).withColumn("cleaned", F.regexp_replace("cleaned", full, ""))

    d = strip(d, "(?md)", BLOCK_QUOTE, "block_quotes_stripped")
    # Blanks before a header may be line ends; what stands before the match is trimmed, so its own start does not matter.
    header = f"(?imd){BIBLIOGRAPHY}"
    before = F.regexp_replace(F.get(F.split("cleaned", header, 2), 0), r"[\s\p{Z}]+$", "")
    d = d.withColumn("_cut", F.col("cleaned").rlike(header)).withColumn("cleaned", F.when(F.col("_cut"), before).otherwise(F.col("cleaned")))
    d = d.withColumn("bibliography_chars_stripped", F.when(F.col("_cut"), F.col("original_chars") - F.length("cleaned")).otherwise(0)).drop("_cut")
    d = strip(d, "(?s)", DOUBLE_QUOTE, "_double")
    d = strip(d, "(?s)", SINGLE_QUOTE, "_single")
    d = d.withColumn("direct_quotes_stripped", F.col("_double") + F.col("_single")).drop("_double", "_single")
    d = strip(d, "", INLINE, "inline_citations_stripped")
    d = strip(d, "", FOOTNOTE, "footnote_refs_stripped")
    d = strip(d, "(?i)", URL, "urls_stripped")
    numbered = f"(?md){NUMBERED}"
    d = d.withColumn("cleaned", F.when(F.regexp_count("cleaned", F.lit(numbered)) > 2, F.regexp_replace("cleaned", numbered, "")).otherwise(F.col("cleaned")))
    collapsed = F.regexp_replace(F.regexp_replace("cleaned", r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    d = d.withColumn("cleaned", trimmed(collapsed)).withColumn("cleaned_chars", F.length("cleaned"))
    share = F.when(F.col("original_chars") == 0, 0.0).otherwise((1 - F.col("cleaned_chars") / F.col("original_chars")) * 100)
    return d.withColumn("reduction_pct", share)


def is_citation_sentence(sentence: Column) -> Column:
    """Has an inline citation, and is short or has a phrase that introduces one."""
    s = trimmed(sentence)
    return (s != "") & s.rlike(INLINE) & ((F.length(s) < 200) | s.rlike(f"(?i){PHRASE}"))
