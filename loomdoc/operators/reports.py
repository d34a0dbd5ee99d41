"""Counts and statistics over chunks, elements, blocks and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """n, mean, median, least and most tokens; mean and median cut to whole numbers."""
    t = F.col("tokens")
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg(t)).cast("int").alias("avg"), F.floor(F.median(t)).cast("int").alias("median"), F.min(t).alias("min"), F.max(t).alias("max"))


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def component_events(elements: DataFrame) -> DataFrame:
    """Component events by kind and name."""
    return counts(elements.where(F.col("type").startswith("component")), "type", "name")


def orphan_code(linked: DataFrame) -> DataFrame:
    """codes and those without a parent instruction."""
    return linked.where("type = 'code'").agg(F.count(F.lit(1)).alias("codes"), F.count_if(F.col("parent_instruction").isNull()).alias("orphans"))


def relation_list(linked: DataFrame, relations: DataFrame) -> DataFrame:
    """Every relation with both texts."""
    a, b = (linked.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text")) for k in ("src", "dst"))
    return relations.join(a, "src").join(b, "dst").select("src", "dst", "type", "confidence", "reason", "src_text", "dst_text")
