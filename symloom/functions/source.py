"""Byte and line slices of file contents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(content: Column) -> Column:
    """UTF-8 text of bytes, null where they are not valid."""
    return F.try_validate_utf8(content.cast("string"))


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes start..end (end excluded) as text; null unless 0 <= start <= end <= size, or if not UTF-8."""
    inside = start.isNotNull() & end.isNotNull() & (start >= 0) & (start <= end) & (end <= F.octet_length(content))
    piece = F.substring(content, (start + 1).cast("int"), (end - start).cast("int"))
    return F.when(inside, text_of(piece))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end, from 1, both included; null unless 1 <= start <= end and the file has the first line."""
    lines = F.split(text, "\n")
    inside = start.isNotNull() & end.isNotNull() & (start >= 1) & (start <= end) & (start <= F.size(lines))
    first = F.when(inside, start).otherwise(F.lit(1)).cast("int")
    return F.when(inside, F.array_join(F.slice(lines, first, F.when(inside, end - start + 1).otherwise(F.lit(1)).cast("int")), "\n"))


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """Byte offset of (line from 1, column): the lines before with their line ends, plus the column."""
    before = F.slice(F.split(text, "\n"), F.lit(1), F.greatest(line - 1, F.lit(0)).cast("int"))
    return F.aggregate(before, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 1) + column


def relative_path(path: Column, root: str = "") -> Column:
    """A path as the sources have it: forward slashes, no leading './', and relative to `root` where it lies below it."""
    clean = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), r"^(?:\./)+", "")
    if not root:
        return clean
    lead = root.rstrip("/") + "/"
    return F.when(F.startswith(clean, F.lit(lead)), F.substr(clean, F.lit(len(lead) + 1))).otherwise(clean)


def sliced(functions: DataFrame, sources: DataFrame, root: str = "") -> DataFrame:
    """functions with `code`: bytes if the offsets fit, else lines; null if the file is missing.

    Paths meet in one form, absolute ones relative to the project's `root`. Each file's content is joined to its
    functions and cut to their code in the same stage; a file with very many functions is split by AQE, as the
    content side is unique by path.
    """
    one = sources.filter("path is not null").groupBy(relative_path(F.col("path"), root).alias("_path")).agg(F.max("content").alias("_content"))
    joined = functions.join(one, relative_path(F.col("file_path"), root) == F.col("_path"), "left")
    content = F.col("_content")
    code = F.coalesce(byte_slice(content, F.col("start_byte"), F.col("end_byte")), line_slice(text_of(content), F.col("start_line"), F.col("end_line")))
    return joined.withColumn("code", code).drop("_path", "_content")
