"""Corpus scans: the files under a folder, and those that are skipped with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import extension

MOST_BYTES = 256 << 20
SKIPPED_FOLDERS = """.git .hg .svn node_modules __pycache__ .venv venv .tox .mypy_cache .pytest_cache dist build out target
 .next .nuxt .cache coverage vendor""".split()
SCANNED = ".png .jpg .jpeg .webp .svg .pdf .docx .odt .html .htm .md .markdown .mdx .txt .text".split()


def in_skipped_folder(relative: Column) -> Column:
    """Whether a folder on the way is hidden or one that holds no documents."""
    listed = "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS if not x.startswith("."))
    return relative.rlike(rf"(^|/)(\.[^/]*|{listed})/")


def scan(spark: SparkSession, folder: str, every: bool = False, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(path, length, content) of the files to look into, and (path, length, reason) of those left out for their size.

    every: files of any extension. Contents are read where they are used; those left out are never read.
    Spark's file listing itself passes over files whose names begin with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^[a-z]+:/*", "/")
    relative = F.substr(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.length(root) + 2)
    files = files.filter(~in_skipped_folder(relative))
    if not every:
        files = files.filter(extension(F.substring_index("path", "/", -1)).isin(SCANNED))
    kept = files.filter(F.col("length") <= most_bytes).select("path", "length", "content")
    left = files.filter(F.col("length") > most_bytes).select("path", "length", F.lit(f"over {most_bytes} bytes").alias("reason"))
    return kept, left


def read_one(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row: (path, length, content, error); content is null where the file is too large."""
    file = spark.read.format("binaryFile").load(path)
    small = F.col("length") <= most_bytes
    return file.select("path", "length", F.when(small, F.col("content")).alias("content"), F.when(~small, F.lit(f"over {most_bytes} bytes")).alias("error"))
