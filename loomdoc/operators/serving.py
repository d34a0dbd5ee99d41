"""From documents to answers: chunks, vectors and points in one direction, retrieval, context and answer in the other."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.mdx import normalize_mdx
from loomdoc.functions.text import chunk_id, clean_markdown, point_id, strip
from loomdoc.operators import chunking, conversation, retrieval, sections, validate
from loomdoc.sources.files import file_name, read_documents, supported
from loomdoc.sources.store import PointStore

Model = Callable[[], Callable[[list[str]], list[list[float]]]]


@dataclass(frozen=True)
class Settings:
    """Names and sizes: from the session's spark.loomdoc.*, else the environment's LOOMDOC_*, else these."""

    dimension: int = 768
    embedding_model: str = ""
    chat_model: str = ""
    api_key: str = field(default="", repr=False)

    @classmethod
    def read(cls, spark: SparkSession) -> Settings:
        found = {}
        for name, default in (("dimension", 768), ("embedding_model", ""), ("chat_model", ""), ("api_key", "")):
            value = spark.conf.get(f"spark.loomdoc.{name}", None) or os.environ.get(f"LOOMDOC_{name.upper()}", default)
            found[name] = int(value) if name == "dimension" else value
        return cls(**found)


def made_chunk(row: DataFrame) -> DataFrame:
    """Chunks with stripped fields, a subtype (text without one), order 0 and an id where there is none."""
    clean = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    out = row.select("*", *(clean(c).alias(f"_{c}") for c in ("text", "heading", "context", "source")), F.coalesce(F.nullif(F.lower(clean("subtype")), F.lit("")), F.lit("text")).alias("_subtype"))
    kept = [c for c in row.columns if c not in ("text", "heading", "context", "source", "subtype", "chunk_id", "order")]
    own = F.col("chunk_id") if "chunk_id" in row.columns else F.lit(None).cast("string")
    return out.select(*kept, *(F.col(f"_{c}").alias(c) for c in ("text", "heading", "context", "source", "subtype")), F.lit(0).alias("order"), F.coalesce(F.nullif(own, F.lit("")), chunk_id(F.col("_source"), F.col("_heading"), F.col("_context"), F.col("_text"))).alias("chunk_id"))


def as_json(chunks: DataFrame) -> Column:
    """A chunk as JSON: id, text, heading, context, type, subtype, order, tokens, source and metadata."""
    have = lambda c, t: F.col(c) if c in chunks.columns else F.lit(None).cast(t)
    rest = F.struct(*(have(c, t).alias(c) for c, t in (("heading_path", "array<string>"), ("row_index", "int"), ("split_part", "int"), ("overlap", "boolean"))))
    return F.to_json(F.struct(have("chunk_id", "string").alias("id"), *(have(c, t).alias(n) for c, t, n in (("text", "string", "text"), ("heading", "string", "heading"), ("context", "string", "context"), ("chunk_type", "string", "type"), ("subtype", "string", "subtype"), ("order", "int", "order"), ("tokens", "int", "tokens"), ("source", "string", "source"))), rest.alias("metadata")))


def chunk_points(chunks: DataFrame) -> DataFrame:
    """The payload of every chunk's point, with its id; the vector follows with embed()."""
    have = lambda c, t: F.col(c) if c in chunks.columns else F.lit(None).cast(t)
    point = point_id(F.col("source"), F.col("heading"), F.col("context"), F.col("subtype"), F.col("split_part"), F.col("text"))
    return chunks.select(
        point.alias("id"), "text", "heading", "context", "source", file_name(F.col("source")).alias("file_name"), "tokens", "subtype",
        have("path", "array<string>").alias("path"), "heading_path", have("command_context", "string").alias("command_context"),
        have("chunk_index", "int").alias("chunk_index"), "split_part", F.lower(F.coalesce(have("type", "string"), F.lit(""))).alias("type"),
    )


def passages(chunks: DataFrame) -> DataFrame:
    """chunks with the passage that an embedder gets."""
    return chunks.withColumn("passage", chunking.passage(F.col("text"), F.col("heading"), F.col("context"), F.col("heading_path")))


def ingest(spark: SparkSession, path: str, store: PointStore, model: Model, preserve_code: bool = False) -> DataFrame:
    """Files below path as points of the store: read, cleaned, cut, validated, embedded. Returns the files that failed, with their error."""
    files = read_documents(spark, path)
    good = supported(files)
    raw = F.when(F.col("doc_type") == "mdx", normalize_mdx("raw")).otherwise(F.col("raw"))
    docs = good.select(F.col("source").alias("doc_id"), (raw if preserve_code else clean_markdown(raw)).alias("text"))
    found = validate.validate(chunking.chunks(sections.document_sections(docs)))
    ready = retrieval.embed(passages(found), model).select("chunk_id", "vector")
    points = chunk_points(found).join(found.select("chunk_id", point_id(F.col("source"), F.col("heading"), F.col("context"), F.col("subtype"), F.col("split_part"), F.col("text")).alias("id")), "id").join(ready, "chunk_id").drop("chunk_id")
    store.upsert(points.dropDuplicates(["id"]))
    return files.where(F.col("_error").isNotNull()).select("source", "_error")


def embedded_queries(queries: DataFrame, model: Model, dimension: int) -> DataFrame:
    """queries with the vector of their text; a model of another dimension is an error when the row is computed."""
    q = retrieval.embed(queries, model, "query", "vector", "")
    wrong = F.raise_error(F.concat(F.lit("a query vector has "), F.size("vector").cast("string"), F.lit(f" numbers, not {dimension}")))
    return q.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(wrong.cast("array<float>")))


def search(store: PointStore, queries: DataFrame, model: Model, k: int = 12, file: str | None = None) -> DataFrame:
    """query_id, text and score of retrieval over the store (of one file, if given): both searches, fusion, reranking, final rows."""
    points = store.read()
    points = points.where(F.col("file_name") == file) if file is not None else points
    asked = embedded_queries(queries, model, store.dimension)
    vector = retrieval.vector_search(points, asked.withColumnRenamed("query_id", "id"), k, "id", "vector")
    words = retrieval.keyword_search(points.withColumnRenamed("id", "chunk_id"), queries, k)
    payload = points.select("id", "text", "heading", "context", "subtype", "command_context")
    full = lambda found: found.join(payload, "id").select("query_id", "text", "type", "score", "rank", "heading", "context", "subtype", "command_context")
    return retrieval.retrieve(full(vector), full(words), queries)


def ask(store: PointStore, queries: DataFrame, model: Model, chat, file: str | None = None) -> DataFrame:
    """query_id, query, context and answer: what the store says of every question, put to the chat model."""
    found = search(store, queries, model, file=file)
    context = conversation.context_blocks(found)
    asked = queries.join(context, "query_id", "left").withColumn("state", conversation.state_of(F.col("query"), F.lit(True)))
    fixed = conversation.guardrail(F.col("intent")) if "intent" in queries.columns else F.lit(None).cast("string")
    out = conversation.answer(asked.withColumn("context", F.coalesce("context", F.lit(""))), chat)
    return out.withColumn("answer", F.coalesce(fixed, F.col("answer"))).select("query_id", "query", "context", "answer")
