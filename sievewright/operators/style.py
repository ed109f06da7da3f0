"""Prose statistics: words, sentences, burstiness, moving type-token ratio, phrases, score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .batches import few

WORD = r"[\p{L}\p{N}][\p{L}\p{N}'-]*"
WINDOW = 50
LEAST_WORDS, FULL_WORDS = 30, 100
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: White space of the SQL; Java's own class has the vertical tab as well.
SPACE = r"[ \t\n\f\r]"

#: (label, weight, pattern between word edges, pattern after the last edge); blanks stand for white space.
PHRASES = [
    ("as an AI", 1.5, "as an ai", ""),
    ("a myriad of", 0.8, "a myriad of", ""),
    ("a testament to", 1.1, "a testament to", ""),
    ("delve into", 1.2, "delve[sd]? into", ""),
    ("moreover,", 0.6, "moreover", r"[,\s]"),
    ("furthermore,", 0.6, "furthermore", r"[,\s]"),
    ("ultimately,", 0.6, "ultimately", r"[,\s]"),
    ("to summarize", 0.8, "to summarize", r"[,\s]"),
    ("in conclusion", 0.8, "in conclusion", r"[,\s]"),
    ("paradigm shift", 0.9, "paradigm shift", ""),
    ("I hope this helps", 1.2, "i hope this helps", ""),
    ("rich tapestry", 1.3, "rich tapestry(?: of)?", ""),
    ("holistic approach", 0.9, "holistic (?:view|approach|perspective)", ""),
    ("multifaceted nature", 1.0, "multifaceted (?:approach|landscape|nature)", ""),
    ("harnessing the power of", 1.0, "harness(?:es|ed|ing)? the power of", ""),
    ("navigating the complexities", 1.0, "navigat(?:ing|ed|es|e) the (?:nuances|intricacies|complexities)", ""),
    ("seamlessly integrates", 1.0, "seamlessly (?:blends?|integrate[sd]|integrate|combine[sd]?)", ""),
    ("fosters a sense/culture", 0.9, "foster(?:ed|ing|s)? a (?:culture|sense|deeper understanding)", ""),
    ("underscores the importance", 0.9, "underscore[sd]? the (?:significance|need|importance)", ""),
    ("serves as a beacon/catalyst", 1.1, "serve[sd]? as a (?:catalyst|cornerstone|reminder|beacon)", ""),
    ("plays a pivotal role", 1.0, "plays? a (?:key|vital|crucial|pivotal) role", ""),
    ("it is important to note", 0.9, "it is (?:crucial|essential|important|worth noting) to (?:highlight|consider|remember|note)", ""),
    ("not only … but also serves to", 0.8, r"not only(?![A-Za-z0-9_])[A-Za-z0-9_\s,]+(?<![A-Za-z0-9_])but (?:also )?(?:highlights|acts as|serves to)", ""),
    ("in today's fast-paced world", 1.4, "in (?:the|today'?s) (?:(?:digital|rapidly changing|ever-evolving|fast-paced) )*(?:environment|era|landscape|world)", ""),
]


def phrase_pattern(body: str, after: str) -> str:
    """Case is ignored as the SQL ignores it: the long s and the Kelvin sign count as letters too (Java's Unicode mode takes more)."""
    inner = re.sub(r"(?<!\\)[sk]", lambda m: {"s": "[s\u017f]", "k": "[k\u212a]"}[m[0]], body).replace(r"[A-Za-z0-9_\s,]", "[A-Za-z0-9_\u017f\u212a\\s,]")
    return ("(?i)" + LEFT + inner.replace(" ", r"\s+") + RIGHT + after).replace(r"\s", SPACE)


def phrase_regex_re2(body: str, after: str) -> str:
    """The same for an engine without look-around, whose word edge is ASCII."""
    inner = body.replace("(?![A-Za-z0-9_])", r"\b").replace("(?<![A-Za-z0-9_])", r"\b")
    return r"(?i)\b" + inner.replace(" ", r"\s+") + r"\b" + after


def word_list(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def sentence_list(text: Column) -> Column:
    """Sentences outside fenced blocks; a fence is a line that starts with three backticks."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")))
    # Fences open and close in turn: dropping every fenced block leaves the text between them.
    state = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("kept")),
        lambda s, x: F.when(x.startswith("```"), F.struct((~s["code"]).alias("code"), s["kept"].alias("kept"))).when(s["code"] | (x == ""), s).otherwise(F.struct(s["code"].alias("code"), F.concat(s["kept"], F.array(x)).alias("kept"))),
    )
    fenced = F.array_join(state["kept"], "\n")
    plain = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    joined = F.when(text.contains("```"), fenced).otherwise(plain)
    return F.filter(F.transform(F.split(joined, rf"(?<=[.!?]){SPACE}+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


def cut(x: Column) -> Column:
    """Four decimals, half up."""
    return F.floor(x * 10000 + 0.5).cast("double") / 10000


def once(c: Column) -> Column:
    """A generator is a barrier to the optimizer, which would else repeat the expression in each of its uses."""
    return F.explode(F.array(c))


def _with_burstiness(df: DataFrame) -> DataFrame:
    """df (with a text) and n_sentences, cv."""
    split = df.select("*", once(sentence_list(F.col("text"))).alias("s"))
    counted = split.select("*", F.size("s").alias("n_sentences"), once(F.filter(F.transform("s", lambda x: F.regexp_count(x, F.lit(WORD)).cast("double")), lambda x: x > 0)).alias("n")).drop("s")
    # Summed up in the order of the sentences as the SQL does (Welford), so that both round alike where a step of the score begins.
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("k", "mean", "squares")))

    def add(s: Column, x: Column) -> Column:
        k, mean = s["k"] + 1, s["mean"] + (x - s["mean"]) / (s["k"] + 1)
        return F.struct(k.alias("k"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    meant = counted.select("*", once(F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("n"), F.lit(1))).alias("mean"))
    cv = F.when(F.size("n") < 2, 0.0).otherwise(F.sqrt(F.aggregate("n", zero, add)["squares"] / F.greatest(F.size("n") - 1, F.lit(1))) / F.nullif("mean", F.lit(0.0)))
    return meant.withColumn("cv", F.coalesce(cv, F.lit(0.0))).drop("n", "mean")


def burstiness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_sentences, cv: sample deviation over mean of the sentences' word counts."""
    return _with_burstiness(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(F.col("id").alias(id_col), "n_sentences", "cv")


def moving(words: list[str], window: int) -> float:
    """Mean share of distinct words over all windows; of a shorter text, its own share."""
    held: dict[str, int] = {}
    total = 0
    for k, w in enumerate(words):
        held[w] = held.get(w, 0) + 1
        if k >= window:
            old = words[k - window]
            if held[old] == 1:
                del held[old]
            else:
                held[old] -= 1
        if k >= window - 1:
            total += len(held)
    n = len(words)
    return total / (window * (n - window + 1)) if n > window else len(held) / n


def _with_ratio(df: DataFrame, window: int) -> DataFrame:
    """df (with words) and mattr (null where there is no word); the words go."""
    keep = [c for c in df.columns if c != "words"]
    at = df.columns.index("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            ratio = pa.array([moving(w, window) if w else None for w in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), ratio], names=[*keep, "mattr"])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in keep), StructField("mattr", DoubleType())]))


def moving_ratio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, mattr of each row that has words."""
    words = docs.select(F.col(id_col).alias("id"), word_list(F.col(text_col)).alias("words"))
    return _with_ratio(words, window).filter("mattr IS NOT NULL").withColumnRenamed("id", id_col)


def fixed_word(body: str) -> str:
    """The longest word that any match of the pattern holds."""
    while (plain := re.sub(r"\([^()]*\)[*+?]?|\[[^\]]*\][*+?]?", " ", body)) != body:
        body = plain
    return max(re.findall(r"[a-z]+", re.sub(r"\w\?", " ", body)), key=len)


def lowered(text: Column) -> Column:
    return F.translate(F.lower(text), "\u017f", "s")


def _counts(text: Column, low: Column) -> list[tuple[str, float, Column]]:
    """A phrase is searched only in texts that hold its fixed word; low can add such texts but lose none."""
    return [(label, weight, F.when(low.contains(fixed_word(body)), F.regexp_count(text, F.lit(phrase_pattern(body, after)))).otherwise(0)) for label, weight, body, after in PHRASES]


def phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, phrase, n, weight of every phrase found."""
    low = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), once(lowered(F.col(text_col))).alias("low"))
    found = [F.struct(F.lit(label).alias("phrase"), n.cast("long").alias("n"), F.lit(weight).alias("weight")) for label, weight, n in _counts(F.col("text"), F.col("low"))]
    every = low.select("id", once(F.array(*found)).alias("found"))
    return every.select("id", F.explode("found").alias("x")).filter("x.n > 0").select(F.col("id").alias(id_col), "x.phrase", "x.n", "x.weight")


BURST = "CASE WHEN cv < 0.25 THEN 0.95D WHEN cv < 0.35 THEN 0.8D WHEN cv < 0.45 THEN 0.5D WHEN cv < 0.55 THEN 0.25D ELSE 0.05D END"
DENSE = "CASE WHEN density >= 2 THEN 1.0D WHEN density >= 1 THEN 0.75D WHEN density >= 0.5 THEN 0.45D WHEN density > 0 THEN 0.2D ELSE 0.0D END"
DIVERSE = "CASE WHEN mattr BETWEEN 0.68 AND 0.76 THEN 0.4D ELSE 0.1D END"
DAMP = f"CASE WHEN n_words < {FULL_WORDS} THEN 0.4D + 0.6D * ((n_words - {LEAST_WORDS}) / {FULL_WORDS - LEAST_WORDS}.0D) ELSE 1.0D END"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", raw: bool = False) -> DataFrame:
    """The style score with its parts; below 30 words there is none."""
    rows = _with_burstiness(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = rows.select("*", once(lowered(F.col("text"))).alias("low"))
    weighted = reduce(Column.__add__, [n * weight for _, weight, n in _counts(F.col("text"), F.col("low"))])
    rows = rows.select("id", "n_sentences", "cv", once(weighted).alias("weighted"), once(word_list(F.col("text"))).alias("words"))
    all_ = _with_ratio(rows.withColumn("n_words", F.size("words")), WINDOW)
    all_ = all_.select(F.col("id").alias(id_col), "n_words", "n_sentences", "cv", "weighted", F.coalesce("mattr", F.lit(0.0)).alias("mattr"))
    all_ = all_.withColumn("density", F.coalesce("weighted", F.lit(0.0)) / (F.greatest("n_words", F.lit(1)) / 100.0))
    exact = F.expr(f"least(1.0D, greatest(0.0D, ({BURST} * 0.45D + {DENSE} * 0.45D + {DIVERSE} * 0.1D) * {DAMP}))")
    ok = F.col("n_words") >= LEAST_WORDS
    all_ = all_.withColumn("raw", F.when(ok, exact).otherwise(0.0))
    level = F.when(F.col("raw") >= 0.75, "HIGH").when(F.col("raw") >= 0.5, "MEDIUM").when(F.col("raw") >= 0.25, "LOW").otherwise("CLEAN")
    return all_.select(id_col, F.col("n_words").cast("long").alias("n_words"), F.col("n_sentences").cast("long").alias("n_sentences"), F.when(ok, cut(F.col("cv"))).otherwise(0.0).alias("burstiness"), F.when(ok, cut(F.col("mattr"))).otherwise(F.col("mattr")).alias("lexical_diversity"), F.when(ok, cut(F.col("density"))).otherwise(0.0).alias("density"), cut(F.col("raw")).alias("score"), level.alias("level"), F.when(ok, "ok").otherwise("insufficient-length").alias("status"), *(["raw"] if raw else []))
