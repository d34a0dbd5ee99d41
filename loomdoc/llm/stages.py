"""The pipeline's stages: each calls one operator on all rows it is given.

Odd rows: a null or empty text passes the filters (no toxic passage, no line, no
shingle, no benchmark word) and encodes as empty; a null id is a document of its
own. Rows that share an id are judged each by its own text, but for near copies,
where an id that goes takes all its rows with it, and where rows equal in id and
text stay once. An empty table stays empty, with its columns. Columns
beyond doc_id, text and source pass through by value whatever they are called,
also under the names of an operator's own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from loomdoc.llm.common import CARRIED
from loomdoc.session import table, written

#: Most rows of ids that are broadcast (16 bytes each).
BROADCAST_ROWS = 200_000


def _columns_back(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from a judgement that carried them all but the id."""
    return judged.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"`{CARRIED}{c}`").alias(c) for c in docs.columns))


def _rest(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "doc_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _columns_back(toxicity.score(docs, model, with_spans=False, carry=_rest(docs)).where("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines."""
    return line_dedup.dedup_lines(docs, counts=None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id; five-word shingles, similarity 0.8."""
    gone = written(near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        left = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(left.where("doc_id IS NULL"))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. The verdict hangs on the text alone, so an id and its text's hash bring it back to the rows."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = written(judged.where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), "text_hash").distinct(), "contaminated").alias("b")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.bad_id")) & (F.xxhash64(F.col("d.text")) == F.col("b.text_hash"))
    return docs.alias("d").join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, same, "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hashes of the ids and of the decoded text."""
    return bpe.encode(docs)
