"""Sections to classified blocks and their relation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions import signals as S
from loomdoc.functions import tables as T
from loomdoc.functions.text import clean_inline, strip
from loomdoc.operators import components as C

# Relation types with their confidence and reason.
FOLLOWS = ("follows", 0.55, "sequential_neighbor_in_section")
COMMAND = ("implements", 0.88, "command_like_code_after_instruction")
LABEL = ("implements", 0.92, "code_immediately_after_instruction_label")
EXAMPLE = ("supports", 0.72, "example_like_code_after_context")
CONTEXTUAL = ("instruction", "explanation", "reference", "configuration", "mixed")


def blocks(sections: DataFrame) -> DataFrame:
    """One row for each paragraph, list item, table row, code and self-closing component."""
    unit = "array<struct<text:string,form:string>>"
    one = lambda text, form: F.array(F.struct(text.alias("text"), F.lit(form).alias("form")))
    many = lambda texts, form: F.transform(texts, lambda x: F.struct(x.alias("text"), F.lit(form).alias("form")))

    def units(e: Column) -> Column:
        return (
            F.when(e["type"] == "paragraph", one(clean_inline(e["text"]), "paragraph"))
            .when(e["type"] == "list", many(F.filter(F.transform(e["items"], clean_inline), lambda x: F.length(x) >= 2), "item"))
            .when(e["type"] == "table", many(T.table_texts(T.parse(e["rows"])), "row"))
            .when(e["type"] == "code", one(strip(e["text"]), "block"))
            .when(e["type"] == "component_self", one(C.self_closing_text(e["name"], e["props"]), "block"))
            .otherwise(F.array().cast(unit))
        )

    stacked = sections.withColumn("_stacks", C.stacks(F.col("content")))
    rows = stacked.select("doc_id", "section_id", "section_index", "heading", "context", F.posexplode(F.arrays_zip("content", "_stacks")).alias("source_index", "z"))
    rows = rows.select("doc_id", "section_id", "section_index", "heading", "context", "source_index", F.col("z.content").alias("e"), C.merged(F.col("z._stacks"), F.lit("")).alias("m"))
    rows = rows.select("*", "m.*").drop("m")
    rows = rows.select("*", F.posexplode(units(F.col("e"))).alias("unit_index", "u")).where("u.text <> ''")
    index = F.row_number().over(Window.partitionBy("doc_id", "section_index").orderBy("source_index", "unit_index")) - 1
    base = S.base_type(F.when(F.col("e.type").startswith("component"), "component").otherwise(F.col("e.type")))
    b = rows.select("doc_id", "section_id", "section_index", "heading", "context", "local_context", "component_context", "component_name", "component_props", "source_index", F.col("e.type").alias("source_type"), F.coalesce("e.ordered", F.lit(False)).alias("ordered"), "e.language", index.alias("block_index"), base.alias("type"), F.col("u.form").alias("form"), F.col("u.text").alias("text"))
    b = b.withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), "section_id", F.concat(F.lit("b"), F.col("block_index").cast("string")))).withColumn("signals", S.signals("text"))
    where = S.contexts(F.col("heading"), F.col("context"), F.col("local_context"))
    f = S.function_of(F.col("type"), F.col("text"), F.col("signals"), F.col("ordered"), where)
    return b.withColumn("_f", f).select("*", "_f.function", "_f.confidence").drop("_f")


def link(blocks: DataFrame) -> DataFrame:
    """Blocks with the ids that their relations point to, and their parents."""
    w = Window.partitionBy("doc_id", "section_index").orderBy("block_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    code = F.col("type") == "code"
    command = code & (F.col("signals.is_command_like") | F.col("signals.has_flags"))
    example = code & (F.col("function").isin("example", "configuration") | (F.col("signals.has_symbols") & ~command))
    short = ~code & (F.col("function") == "instruction") & (F.size(F.split(strip(F.col("text")), r"\s+")) <= 16) & (strip(F.col("text")).endswith(":") | F.col("signals.is_labeled_action"))
    me = F.struct("id", "text")
    nearest = lambda condition: F.last(F.when(condition, me), True).over(before)
    df = blocks.select(
        "*",
        F.lag("id").over(w).alias("_follows"),
        F.when(command, nearest(~code & (F.col("function") == "instruction"))).alias("_command"),
        F.when(code, F.lag(F.when(short, me)).over(w)).alias("_label"),
        F.when(example, nearest(~code & F.col("function").isin(*CONTEXTUAL))).alias("_example"),
    )
    instruction, context = F.coalesce("_label.text", "_command.text"), F.col("_example.text")
    fallback = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("heading", "local_context", "context")))
    return df.select("*", instruction.alias("parent_instruction"), F.coalesce(context, F.when(code & instruction.isNull(), fallback)).alias("parent_context")).withColumn(
        "retrieval_text", S.retrieval_text(*map(F.col, ("context", "heading", "local_context", "function", "parent_instruction", "parent_context", "text")))
    )


def relations(linked: DataFrame) -> DataFrame:
    """Edges (src, dst, type, confidence, reason) of linked blocks; none to itself, none twice."""
    edge = lambda dst, kind: F.struct(dst.alias("dst"), *(F.lit(v).alias(k) for k, v in zip(("type", "confidence", "reason"), kind)))
    edges = F.array(edge(F.col("_follows"), FOLLOWS), edge(F.col("_command.id"), COMMAND), edge(F.col("_label.id"), LABEL), edge(F.col("_example.id"), EXAMPLE))
    return linked.select(F.col("id").alias("src"), F.explode(F.filter(edges, lambda e: e["dst"].isNotNull() & (e["dst"] != F.col("id")))).alias("e")).select("src", "e.*")

