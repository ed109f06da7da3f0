"""Incremental audits: hourly roll-ups with late data, and a file-stream audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import markers as m


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums per hour and type; the same plan for a table and for a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    rolled = source.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rolled.select(F.col("w.start").alias("hour"), "event_type", "n", "value")


def stream_audit(spark: SparkSession, folder: str, out: str, checkpoint: str, most_bytes: int = 256 << 20) -> StreamingQuery:
    """Scans files that arrive in a folder for markers, once each; stops when none is left. A file over most_bytes is a row that says why it was skipped."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    view = F.lower(F.regexp_replace(F.decode("content", "iso-8859-1"), r"[^\x20-\x7e]", "."))
    seen = files.filter(F.col("length") <= most_bytes).select("path", "length", view.alias("view"))
    rows = seen.selectExpr("path", "length", f"{m.holds('view', m.C2PA)} AS has_c2pa", f"{m.confidence('view')} AS confidence", *(f"{m.holds('view', x)} AS has_{k}" for k, x in m.PRIVACY.items()), "CAST(NULL AS STRING) AS skipped")
    # Without their content, which is never read.
    large = files.filter(F.col("length") > most_bytes).select("path", "length", F.lit(f"over {most_bytes} bytes").alias("skipped"))
    rows = rows.unionByName(large, allowMissingColumns=True)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
