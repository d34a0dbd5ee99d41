"""Incremental ingestion and conversation memory on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomdoc.functions.mdx import normalize_mdx
from loomdoc.functions.text import clean_markdown
from loomdoc.operators.chunking import chunks
from loomdoc.operators.sections import document_sections
from loomdoc.operators.validate import validate
from loomdoc.sources.files import doc_type, file_name, normal_newlines


def chunked(docs: DataFrame, preserve_code: bool = False) -> DataFrame:
    """Valid chunks of documents (doc_id, doc_type, raw), all stages in one plan."""
    raw = F.when(F.col("doc_type") == "mdx", normalize_mdx("raw")).otherwise(F.col("raw"))
    text = raw if preserve_code else clean_markdown(raw)
    return validate(chunks(document_sections(docs.select("doc_id", text.alias("text")))))


def ingest_stream(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.{md,mdx}") -> StreamingQuery:
    """New files below path, chunked batch by batch into sink(chunks, batch); ends when all present files are done."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    docs = files.select(F.col("_metadata.file_path").alias("source"), normal_newlines(F.col("value")).alias("raw")).where("raw <> ''")
    docs = docs.select(F.sha1("source").alias("doc_id"), "source", file_name(F.col("source")).alias("file_name"), doc_type(F.col("source")).alias("doc_type"), "raw").where("doc_type <> 'unknown'")

    def each(batch: DataFrame, number: int) -> None:
        sink(chunked(batch), number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Memory(StatefulProcessor):
    """Keeps a conversation's last messages in a list state and emits them with each batch."""

    def __init__(self, max_turns: int = 4):
        self.most = 2 * max_turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "turn long, role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(r) for df in rows for r in df[["turn", "role", "text"]].itertuples(index=False)]
        kept = sorted([*self.held.get(), *new], key=lambda r: r[0])[-self.most :]
        self.held.put([(int(t), r, x) for t, r, x in kept])
        yield pd.DataFrame([(key[0], int(t), r, x) for t, r, x in kept], columns=["conv_id", "turn", "role", "text"])

    def close(self) -> None:
        pass


def memory_stream(messages: DataFrame, max_turns: int = 4) -> DataFrame:
    """The memory of every conversation that a batch of a stream touches; needs the RocksDB state store."""
    return messages.groupBy("conv_id").transformWithStateInPandas(Memory(max_turns), "conv_id long, turn long, role string, text string", "Update", "None")
