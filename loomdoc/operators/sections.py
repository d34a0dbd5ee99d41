"""Elements to heading sections with text, context, type, role and keywords.

Headings are resolved by windows over a document's elements: the ancestor at
level k is the last heading of that level after the last one of every lower
level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions import tables as T
from loomdoc.functions.text import clean_inline, collapse, keywords, let, slug, split_words, strip
from loomdoc.operators.elements import sectioned


def with_paths(elements: DataFrame) -> DataFrame:
    """section_index, heading and path (the heading's ancestors) for every element."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("type") == "heading"
    df = elements.withColumn("section_index", F.sum(is_heading.cast("int")).over(w))
    for k in range(1, 7):
        df = df.withColumn(f"_h{k}", F.last(F.when(is_heading & (F.col("level") == k), F.struct("pos", "text")), True).over(w))
    df = df.withColumn("_level", F.last(F.when(is_heading, F.col("level")), True).over(w)).withColumn("heading", F.coalesce(F.last(F.when(is_heading, F.col("text")), True).over(w), F.lit("Overview")))
    levels = []
    for k in range(1, 7):
        h = F.col(f"_h{k}")
        lower = [F.col(f"_h{j}.pos") for j in range(1, k)]
        newest = F.greatest(*lower) if len(lower) > 1 else lower[0] if lower else F.lit(None)
        levels.append(F.when(h.isNotNull() & (F.lit(k) < F.col("_level")) & (newest.isNull() | (h["pos"] > newest)), h["text"]))
    return df.withColumn("path", F.array_compact(F.array(*levels))).drop(*(f"_h{k}" for k in range(1, 7)), "_level")


def part_texts(e: Column) -> Column:
    """The lines that an element adds to its section's text."""
    items = F.filter(F.transform(e["items"], clean_inline), lambda x: F.length(x) >= 2)
    return (
        F.when(e["type"] == "paragraph", F.array(clean_inline(e["text"])))
        .when(e["type"] == "list", F.transform(items, lambda x, i: F.concat(F.when(e["ordered"], F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x)))
        .when(e["type"] == "table", F.transform(T.parse(e["rows"])["cells"], lambda r: clean_inline(F.array_join(r, " | "))))
        .when(e["type"] == "code", F.array(strip(F.coalesce(e["text"], F.lit("")))))
        .otherwise(F.array(clean_inline(F.coalesce(e["text"], F.lit("")))))
    )


def context_of(path: Column, heading: Column) -> Column:
    named = F.filter(path, lambda p: (F.coalesce(p, F.lit("")) != "") & (F.lower(p) != "root"))
    return F.when(F.size(named) > 0, F.array_join(named, " > ")).otherwise(F.coalesce(F.when(heading != "", heading), F.lit("root")))


def section_type(types: Column) -> Column:
    has = lambda *k: F.arrays_overlap(types, F.array(*map(F.lit, k)))
    return F.when(has("procedure"), "procedure").when(has("table", "generic_table"), "structured").when(has("code"), "code").when(has("bullets", "list"), "list").when(F.size(types) > 1, "mixed").otherwise("text")


def content_role(types: Column) -> Column:
    has = lambda *k: F.arrays_overlap(types, F.array(*map(F.lit, k)))
    return F.when(has("table", "generic_table"), "table").when(has("procedure"), "procedure").when(has("code"), "code").when(has("bullets", "list"), "list").otherwise("text")


def command_context(path: Column, heading: Column) -> Column:
    """The first short back-ticked or whole text, from the heading up its path, without options and symbols."""
    ok = lambda x: (collapse(x) != "") & (F.size(split_words(x)) <= 6) & ~x.rlike(r"--[a-zA-Z0-9][a-zA-Z0-9-]*|-[a-zA-Z]") & ~x.rlike(r"[|><={}]")
    candidates = F.concat(F.array(F.coalesce(heading, F.lit(""))), F.reverse(path))
    each = F.flatten(F.transform(candidates, lambda c: F.concat(F.regexp_extract_all(c, F.lit("`([^`]+)`"), 1), F.array(c))))
    return F.get(F.transform(F.filter(each, ok), collapse), F.lit(0))


def sections(elements: DataFrame) -> DataFrame:
    """One row for each section with content of an element table, its elements in order as `content`."""
    e = with_paths(elements)
    content = e.where("type <> 'heading'").groupBy("doc_id", "section_index").agg(
        F.min("heading").alias("heading"),
        F.first("path").alias("path"),
        F.array_sort(F.collect_list(F.struct("pos", "type", "level", "text", "items", "ordered", "rows", "language", "name", "props"))).alias("content"),
    )
    return described(content.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_index", "heading", "path", "content"))).alias("sections")))


def document_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same of documents' cleaned texts, within each row: no shuffle."""
    return described(sectioned(docs, id_col, text_col))


def described(docs: DataFrame) -> DataFrame:
    """One row for each section of doc_id and `sections`, in their order; paragraphs of fewer than three characters are left out."""
    kept = lambda x: (x["type"] != "paragraph") | (F.length(clean_inline(x["text"])) >= 3)
    whole = F.transform("sections", lambda x: F.struct(x["section_index"].alias("section_index"), x["heading"].alias("heading"), x["path"].alias("path"), F.filter(x["content"], kept).alias("content")))
    rows = docs.select("doc_id", F.posexplode(F.filter(whole, lambda x: F.size(x["content"]) > 0)).alias("section_order", "s")).select("doc_id", "section_order", "s.*")
    texts = rows.withColumn("text", F.array_join(F.filter(F.flatten(F.transform("content", part_texts)), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n"))
    types = F.array_distinct(F.transform("content", lambda x: F.when(x["type"] == "table", "generic_table").when(x["type"].startswith("component"), "component").otherwise(x["type"])))
    order = F.col("section_order")
    return texts.select(
        "doc_id",
        "section_order",
        "section_index",
        F.concat(F.lit("s"), order.cast("string"), F.lit("_"), slug("heading")).alias("section_id"),
        "heading",
        "path",
        "content",
        "text",
        context_of(F.col("path"), F.col("heading")).alias("context"),
        section_type(types).alias("section_type"),
        content_role(types).alias("content_role"),
        command_context(F.col("path"), F.col("heading")).alias("command_context"),
        keywords("text").alias("keywords"),
        (F.col("section_index") == 0).alias("synthetic"),
        F.size("content").alias("block_count"),
    )


def document_texts(sections: DataFrame) -> DataFrame:
    """doc_id and its sections' texts, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("section_index", "text")))
    return sections.groupBy("doc_id").agg(F.array_join(F.filter(F.transform(ordered, lambda x: x["text"]), lambda x: x != ""), "\n\n").alias("text"))


def structure_profile(sections: DataFrame) -> DataFrame:
    """Counts of each kind of content, words, and a role that knows mixtures."""
    n = lambda *k: F.size(F.filter("content", lambda x: x["type"].isin(*k)))
    words = F.size(split_words(F.col("text")))
    counts = sections.select("doc_id", "section_id", n("paragraph").alias("paragraphs"), n("list").alias("lists"), n("table").alias("tables"), n("code").alias("codes"), words.alias("words"), keywords("text", 12, 3).alias("keywords"))
    kinds = sum(((F.col(c) > 0).cast("int") for c in ("lists", "tables", "codes")), F.lit(0))
    role = F.when(kinds > 1, "mixed").when(F.col("tables") > 0, "table").when(F.col("codes") > 0, "code").when(F.col("lists") > 0, "list").otherwise("text")
    return counts.withColumn("role", role)


def list_clean(items: Column, least: int = 1) -> Column:
    """Items without outer white space, of at least `least` characters."""
    return F.filter(F.transform(items, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: F.length(x) >= least)


def list_ordered(items: Column) -> Column:
    """Whether at least half of the items, and one, begin with a digit and a stop or bracket."""
    votes = F.size(F.filter(items, lambda x: x.rlike(r"(?s)^\s*\p{Nd}[.)].")))
    return votes >= F.greatest(F.lit(1), F.floor(F.size(items) / 2))


def parse_list(items: Column) -> Column:
    """struct<items, ordered, item_count> of raw items: distinct ones of two characters or more; null without any."""
    block = lambda c: F.when(F.size(c) > 0, F.struct(c.alias("items"), list_ordered(c).alias("ordered"), F.size(c).alias("item_count")))
    return let(F.array_distinct(list_clean(items, 2)), block)


def enrich_list(items: Column) -> Column:
    """struct<items, ordered> of a raw list block; a list without items stays, unordered."""
    block = lambda c: F.struct(c.alias("items"), ((F.size(c) > 0) & list_ordered(c)).alias("ordered"))
    return let(list_clean(F.coalesce(items, F.array().cast("array<string>"))), block)
