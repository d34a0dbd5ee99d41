"""Markdown and MDX files as a document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.text import strip


def doc_type(path: Column) -> Column:
    """markdown, mdx or unknown, by the suffix."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(suffix == ".md", "markdown").when(suffix == ".mdx", "mdx").otherwise("unknown")


def file_name(path: Column) -> Column:
    """The part after the last slash; null for an empty path."""
    return F.when(F.coalesce(path, F.lit("")) != "", F.element_at(F.split(path, "/"), -1))


def normal_newlines(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\r\n?", "\n"))


def read_documents(spark: SparkSession, path: str, glob: str = "*.{md,mdx}", strict: bool = False) -> DataFrame:
    """doc_id, source, file_name, doc_type, raw and _error of every file below path.

    Unsupported and empty files carry an error and no text; with strict they
    fail the read when their row is computed.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    kind, raw = doc_type(F.col("source")), normal_newlines(F.col("value"))
    error = F.when(kind == "unknown", "unsupported file type").when(raw == "", "empty file")
    out = files.select(F.sha1("source").alias("doc_id"), "source", file_name(F.col("source")).alias("file_name"), kind.alias("doc_type"), F.when(error.isNull(), raw).alias("raw"), error.alias("_error"))
    return out.withColumn("raw", F.when(F.col("_error").isNotNull(), F.raise_error(F.concat(F.col("source"), F.lit(": "), F.col("_error")))).otherwise(F.col("raw"))) if strict else out


def supported(docs: DataFrame) -> DataFrame:
    """Documents of a known type with text."""
    return docs.where(F.col("_error").isNull())
