"""Chunk and vector validation: sizes, noise, first of equal beginnings, score and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions.text import split_words, strip
from loomdoc.operators.chunking import density

# Token bounds and subtypes.
LEAST, LIGHT, MOST = 20, 10, 800
ATOMIC, LIGHTWEIGHT = ("code_block", "table_row"), ("note", "fact")


def right_size(tokens: Column, subtype: Column) -> Column:
    return (tokens >= F.when(subtype.isin(*ATOMIC, *LIGHTWEIGHT), LIGHT).otherwise(LEAST)) & (tokens <= MOST)


def is_noise(text: Column, subtype: Column) -> Column:
    """Fewer than five words, or no letter or digit; never for atomic and light chunks."""
    return ~subtype.isin(*ATOMIC, *LIGHTWEIGHT) & ((F.size(split_words(text)) < 5) | ~text.rlike(r"[\p{L}\p{N}]"))


def dedupe_key(text: Column) -> Column:
    return F.lower(F.substring(text, 1, 200))


def first_of_equal(chunks: DataFrame, order: str = "seq") -> DataFrame:
    """The first chunk of each document with its beginning of 200 characters."""
    w = Window.partitionBy("doc_id", dedupe_key(F.col("text"))).orderBy(order)
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def score(tokens: Column, subtype: Column, types: Column, text: Column) -> Column:
    d = density(types)
    exact = (
        F.when(tokens.between(80, 400), 2.0).when(tokens > 400, 1.0).otherwise(0.5)
        + F.when(subtype.isin(*ATOMIC), 2.5).when(subtype == "procedure_group", 2.0).when(subtype == "text", 1.0).otherwise(0.0)
        + F.when(d == "high", 2.0).when(d == "medium", 1.2).otherwise(0.5)
        + F.when(F.contains(text, F.lit("\n\n")), 0.5).otherwise(0.0)
        + F.when(F.contains(text, F.lit(":")), 0.5).otherwise(0.0)
        - F.when(F.size(split_words(text)) < 6, 1.5).otherwise(0.0)
    )
    return F.round(exact, 6)  # sums of the same tenths are equal


def validate(chunks: DataFrame) -> DataFrame:
    """Chunks that pass, with score and rank in their document (equal scores in document order)."""
    c = chunks.withColumn("text", strip("text")).where(right_size(F.col("tokens"), F.col("subtype")) & ~is_noise(F.col("text"), F.col("subtype")))
    c = first_of_equal(c).withColumn("score", score(F.col("tokens"), F.col("subtype"), F.col("content_types"), F.col("text")))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "seq")))


def valid_vector(v: Column, least: int = 10, most: int = 4096) -> Column:
    """A dimension in bounds and finite numbers only."""
    return v.isNotNull() & F.size(v).between(least, most) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def valid_pairs(points: DataFrame, order: str, text_col: str = "text", vector_col: str = "vector") -> DataFrame:
    """Rows with a text of five characters or more and a valid vector of the first valid vector's dimension."""
    v = F.col(vector_col)
    first = points.where(valid_vector(v)).agg(F.min_by(F.size(v), F.col(order)).alias("_dim"))
    ok = points.where((F.length(strip(F.col(text_col))) >= 5) & valid_vector(v))
    return ok.join(F.broadcast(first), F.size(v) == F.col("_dim")).drop("_dim")  # one row


def drop_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after, removed and percent."""
    n = before.agg(F.count(F.lit(1)).alias("before")).crossJoin(after.agg(F.count(F.lit(1)).alias("after")))  # one row each
    removed = F.col("before") - F.col("after")
    return n.select("before", "after", removed.alias("removed"), F.when(F.col("before") > 0, F.round(100.0 * removed / F.col("before"), 2)).otherwise(0.0).alias("percent"))
