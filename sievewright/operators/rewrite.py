"""Scoring of rewrites: bigram divergence, choice among candidates, residual risk, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))


def divergence(original: Column, candidate: Column) -> Column:
    """One less the Jaccard similarity of word pairs; texts without pairs do not diverge."""
    a, b = tokens(original), tokens(candidate)
    x, y = bigrams(a), bigrams(b)
    shared = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - shared
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0).when(union == 0, 0.0).otherwise(1 - shared / union)


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "utf-16be")) / 2


def length_ratio(original: Column, candidate: Column) -> Column:
    n = utf16_length(original)
    return F.when(n == 0, 1.0).otherwise(utf16_length(candidate) / F.greatest(n, F.lit(1)))


def score(original: Column, candidate: Column) -> Column:
    ratio = length_ratio(original, candidate)
    return divergence(original, candidate) - F.when((ratio > 2) | (ratio < 0.5), 0.15).otherwise(0.0)


def select_candidate(rows: DataFrame, key: str, order: str, original: str, candidate: str) -> DataFrame:
    """Per key, the candidate with the best score; the first wins ties."""
    scored = rows.withColumn("score", score(F.col(original), F.col(candidate)))
    return scored.groupBy(key).agg(F.max_by(order, F.struct("score", -F.col(order))).alias("best"), F.max("score").alias("score"), F.count("*").alias("candidates"))


def residual_risk(original: Column, rewritten: Column) -> Column:
    d, n = divergence(original, rewritten), F.size(tokens(rewritten))
    return F.when((d < 0.2) | (n > 400), "higher").when(n < 60, "lower").otherwise("moderate")


def prompt(template: Column, text: Column, language: Column) -> Column:
    """Fills the first place of each kind."""
    return _fill(_fill(template, "{LANGUAGE}", language), "{TEXT}", text)


def _fill(template: Column, place: str, value: Column) -> Column:
    at = F.instr(template, place)
    return F.when(at == 0, template).otherwise(F.concat(F.substring(template, F.lit(1), at - 1), value, F.substring(template, at + len(place), F.length(template))))
