"""Audit rows, summary, ranking and verdict over inspected corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markers as m

RANKS = {"likely-false-positive": 0, "informational": 1, "probable": 2, "confirmed": 3}


def rank(confidence: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in RANKS.items():
        out = F.when(confidence == name, n).otherwise(out)
    return out


def audit_items(items: DataFrame, findings: DataFrame, key: str = "name") -> DataFrame:
    """One wide row per item.

    items: key, kind, format, has_c2pa, has_ai_metadata, privacy (array), suspicious_total unless findings bring it.
    findings: key, code, confidence and, where they add up to suspicious_total, n. Aggregated before the join, so a hot item costs one row.
    """
    total = [F.sum("n").cast("long").alias("suspicious_total")] if "n" in findings.columns else []
    by = findings.groupBy(key).agg(
        F.count("*").alias("n_findings"),
        F.coalesce(F.sum(rank(F.col("confidence"))), F.lit(0)).cast("long").alias("rank_sum"),
        *(F.count_if(F.col("confidence") == c).alias(f"n_{c.replace('-', '_')}") for c in RANKS),
        *total,
    )
    out = items.join(by, key, "left")
    numbers = ["n_findings", "rank_sum", *(f"n_{c.replace('-', '_')}" for c in RANKS), *(["suspicious_total"] if total else [])]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers})
    substantiated = F.col("n_confirmed") + F.col("n_probable") > 0
    actionable = F.col("has_c2pa") | (F.size("privacy") > 0) | (F.col("suspicious_total") > 0) | substantiated
    weight = F.col("rank_sum") * 10 + F.size("privacy") * 25 + F.when(F.col("has_c2pa"), 40).otherwise(0) + F.when(F.col("suspicious_total") > 0, 15).otherwise(0)
    highest = F.lit("none")
    for name in RANKS:
        highest = F.when(F.col(f"n_{name.replace('-', '_')}") > 0, name).otherwise(highest)
    return out.withColumn("actionable", actionable).withColumn("weight", weight.cast("long")).withColumn("highest_confidence", highest)


def summary(audited: DataFrame) -> DataFrame:
    """One row: the counters of an audit."""
    has = lambda label: F.count_if(F.array_contains("privacy", label))
    return audited.agg(
        F.count("*").alias("total"),
        F.count_if("actionable").alias("actionable"),
        F.count_if("has_c2pa").alias("with_c2pa"),
        F.count_if("has_ai_metadata").alias("with_ai_metadata"),
        F.count_if(F.col("suspicious_total") > 0).alias("with_invisible_text"),
        has("location").alias("with_location"),
        has("device").alias("with_device"),
        has("author").alias("with_author"),
        has("timestamps").alias("with_timestamps"),
        *(F.coalesce(F.sum(f"n_{c.replace('-', '_')}"), F.lit(0)).cast("long").alias(f"findings_{c.replace('-', '_')}") for c in RANKS),
    )


def ranked(audited: DataFrame, limit: int | None = None) -> DataFrame:
    """Worst first; names break ties in Unicode order. With a limit this is a top-k, not a sort."""
    out = audited.orderBy(F.desc("weight"), F.collate("name", "UNICODE"))
    return out.limit(limit) if limit is not None else out


def marker_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The marker scan of one text per item, in the shape that audit_items takes."""
    view = F.lower(F.regexp_replace(text, r"[^\x20-\x7e]", "."))
    seen = docs.select(key, view.alias("view"))
    labels = F.filter(F.array(*(F.when(F.expr(m.holds("view", needles)), F.lit(label)) for label, needles in m.PRIVACY.items())), lambda x: x.isNotNull())
    return seen.select(key, F.expr(m.holds("view", m.C2PA)).alias("has_c2pa"), F.expr(m.holds("view", m.PROVENANCE)).alias("has_ai_metadata"), labels.alias("privacy"), F.expr(m.confidence("view")).alias("marker_confidence"))
