"""Source trees and document folders as tables of (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import symbols as sym


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder, paths relative to it; unreadable files are skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    # The scan reports full addresses; both sides are reduced to a path that begins with one slash.
    base = "/" + root.split(":")[-1].strip("/") + "/"
    full = F.regexp_replace("path", r"^\w+:/*", "/")
    return raw.select(F.regexp_replace(full, "^" + _quoted(base), "").alias("path"), "content", "length")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def go_sources(spark: SparkSession, root: str) -> DataFrame:
    """Go files without tests, and without the folders that a walk leaves out."""
    return read_tree(spark, root).filter(sym.is_go_source(F.col("path")))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of Markdown, text, reStructuredText and AsciiDoc files, whatever the case of their endings."""
    own = read_tree(spark, root).filter(sym.is_document(F.col("path")))
    return own.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
