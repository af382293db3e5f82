"""Stylometry and the scores and verdicts made from it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_words, bound, trimmed, words

# Forms of "be", hedging words, and punctuation that is counted.
BE_VERBS = ["is", "are", "was", "were", "be", "been", "being"]
HEDGES = [
    "might", "could", "may", "perhaps", "possibly", "arguably", "seemingly", "likely", "presumably",
    "apparently", "essentially", "fundamentally", "notably", "importantly", "significantly",
]
PUNCTUATION = ".,;:!?\"'()"


def style_sentences(text: Column) -> Column:
    """Cut after .!? at white space; sentences of over 5 characters, or else the whole text."""
    parts = F.filter(F.split(trimmed(text), r"(?<=[.!?])\s+"), lambda x: F.length(x) > 5)
    return bound(parts, lambda p: F.when(F.size(p) == 0, F.array(text)).otherwise(p))


def n_hapaxes(tokens: Column) -> Column:
    """How many words occur once: in the sorted words, those unlike both neighbours."""
    alone = lambda o: F.filter(o, lambda x, i: ((i == 0) | (F.get(o, i - 1) != x)) & ((i + 1 == F.size(o)) | (F.get(o, i + 1) != x)))
    return bound(F.array_sort(tokens), lambda o: F.size(alone(o)))


def style_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the nine features."""
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)

    def of_words(w: Column) -> Column:
        n = F.size(w)
        grams = F.when(n < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " ")))
        share = lambda among: F.size(F.filter(w, lambda x: x.isin(among))) / n
        types = F.size(F.array_distinct(w))
        return F.struct(
            (types / n).alias("vocab_diversity"),
            (F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)) / n).alias("avg_word_length"),
            (n_hapaxes(w) / types).alias("rare_word_ratio"),
            bound(grams, lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.greatest(F.size(g), F.lit(1))).alias("ngram_repetition"),
            share(BE_VERBS).alias("passive_voice_estimate"),
            share(HEDGES).alias("hedging_words_ratio"),
        )

    def of_lengths(lengths: Column) -> Column:
        return bound(mean(lengths), lambda m: F.struct(m.alias("avg_sentence_length"), F.sqrt(mean(F.transform(lengths, lambda x: (x - m) * (x - m)))).alias("sentence_length_std")))

    found = words(F.col(text_col))
    real = bound(found, lambda w: F.when(F.size(w) == 0, F.array(F.lit(""))).otherwise(w))
    lengths = F.transform(style_sentences(F.col(text_col)), lambda s: F.size(blank_words(s)))
    marks = F.length(text_col) - F.length(F.translate(F.col(text_col), PUNCTUATION, ""))
    d = docs.withColumn("_w", bound(real, of_words)).withColumn("_l", bound(lengths, of_lengths))
    return d.select("*", "_l.*", "_w.*", (marks / F.greatest(F.length(text_col), F.lit(1))).alias("punctuation_density")).drop("_w", "_l")


FEATURES = ["avg_sentence_length", "sentence_length_std", "vocab_diversity", "avg_word_length", "punctuation_density", "rare_word_ratio", "ngram_repetition", "passive_voice_estimate", "hedging_words_ratio"]


def _steps(value: Column, *steps: tuple[str, float, float]) -> Column:
    out = F
    for side, bound, gain in steps:
        out = out.when(value < bound if side == "<" else value > bound, F.lit(gain))
    return out.otherwise(F.lit(0.0))


def style_score(sentence_length_std: Column, hedging: Column, repetition: Column, rare: Column) -> Column:
    out = 0.5 + _steps(sentence_length_std, ("<", 5, 0.15), (">", 12, -0.15))
    out = out + _steps(hedging, (">", 0.04, 0.20), ("<", 0.005, -0.10))
    out = out + _steps(repetition, (">", 0.20, 0.10), ("<", 0.05, -0.10))
    out = out + _steps(rare, ("<", 0.35, 0.10), (">", 0.55, -0.10))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def perplexity_score(perplexity: Column) -> Column:
    odd = perplexity.isNull() | F.isnan(perplexity) | (F.abs(perplexity) == math.inf)
    return F.when(odd, 0.5).when(perplexity < 25, 0.95).when(perplexity < 50, 0.75).when(perplexity < 100, 0.45).when(perplexity < 200, 0.25).otherwise(0.10)


def blended(classifier: Column, perplexity: Column, style: Column, n_words: Column) -> Column:
    """70 % classifier, 15 % perplexity (texts of over 50 words), 15 % style (over 100 words); what is missing is the classifier's."""
    return 0.70 * classifier + 0.15 * F.when(n_words > 50, perplexity).otherwise(classifier) + 0.15 * F.when(n_words > 100, style).otherwise(classifier)


def verdict(p: Column) -> Column:
    """(verdict, confidence) of a blended probability."""
    kind = F.when(p > 0.70, "AI-LIKELY").when(p > 0.45, "MIXED").otherwise("HUMAN")
    sure = F.when((p > 0.85) | (1 - p > 0.85), "high").otherwise("medium")
    return F.struct(kind.alias("verdict"), sure.alias("confidence"))


def plain_verdict(p: Column) -> Column:
    """(verdict, confidence) of a classifier's probability alone."""
    kind = F.when(p > 0.8, "AI-LIKELY").when(p > 0.5, "MIXED").otherwise("HUMAN")
    sure = F.when((p > 0.95) | (1 - p > 0.95), "high").otherwise("medium")
    return F.struct(kind.alias("verdict"), sure.alias("confidence"))
