"""The registered queries of the engine's own operators and their SQL.

The supplied documents hold no Markdown, so queries on Markdown operators build
it from the documents' own lines with one expression in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.functions import mdx, signals, tables, text
from loomdoc.operators import blocks, chunking, conversation, elements, reports, retrieval, sections, serving, validate
from loomdoc.plans.oracles import SQL
from loomdoc.session import spread, table
from loomdoc.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines: doc_id, pos (from 0), line."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")


@query
def clean_text(spark, sf_dir):
    t = F.concat(F.lit("![i](u) see [docs](x) <b>ok</b>\n**Applies to:** all\n  "), F.col("text"), F.lit("\n\n\n\n end "))
    return _docs(spark, sf_dir).select("doc_id", text.clean_markdown(t).alias("cleaned"))


@query
def strip_html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html("html").alias("plain"))


@query
def keywords(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.keywords("text"), ",").alias("keywords"))


@query
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.tokens("text").cast("long").alias("tokens"))


@query
def sentence_split(spark, sf_dir):
    s = text.sentences("text")
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(s).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query
def chunk_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.chunk_id(F.col("source"), F.lit("Overview"), F.lit(None).cast("string"), F.col("text")).alias("chunk_id"))


@query
def point_uuid(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.point_id(F.col("source"), F.lit("Overview"), F.lit(""), F.lit("text_block"), F.lit(0), F.col("text")).alias("id"))


def _packed(spark, sf_dir):
    """Sentence groups of at most 300 tokens as chunks."""
    packs = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.pack(text.sentences("text"), 300)).alias("seq", "text"))
    return packs.select("doc_id", F.col("seq").cast("long").alias("seq"), "text", text.tokens("text").alias("tokens"), F.lit("text_split").alias("subtype"), F.array(F.lit("paragraph")).alias("content_types"))


@query
def chunk_score_rank(spark, sf_dir):
    v = validate.validate(_packed(spark, sf_dir))
    return v.select("doc_id", "seq", F.col("tokens").cast("long").alias("tokens"), "score", F.col("rank").cast("long").alias("rank"))


@query
def dedupe_first200(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(validate.dedupe_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query
def noise_filter(spark, sf_dir):
    sub = F.lit("text_block")
    t = text.strip("line")
    return _lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), validate.is_noise(t, sub).alias("noise"), validate.right_size(text.tokens(t), sub).alias("right_size"))


@query
def signal_flags(spark, sf_dir):
    df = _lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), signals.signals("line").alias("s"))
    return df.select("doc_id", "pos", *(F.col(f"s.{k}").alias(k) for k in signals.FLAGS))


def _classified(spark, sf_dir):
    """Lines as blocks: every fifth one code, every third one a list item."""
    df = _lines(spark, sf_dir).withColumn("type", F.when(F.col("pos") % 5 == 4, "code").when(F.col("pos") % 3 == 1, "list").otherwise("text")).withColumn("line", F.when(F.col("pos") % 4 == 2, F.concat(F.lit("Run: check "), F.col("line"))).when(F.col("pos") % 5 == 4, F.concat(F.lit("x = "), F.col("line"))).otherwise(F.col("line")))
    df = df.withColumn("signals", signals.signals("line"))
    where = signals.contexts(F.lit("Overview"), F.lit("Overview"), F.lit(""))
    return df.withColumn("f", signals.function_of(F.col("type"), F.col("line"), F.col("signals"), F.col("pos") % 2 == 0, where)).select("doc_id", "pos", "type", F.col("line").alias("text"), "signals", "f.function", "f.confidence")


@query
def function_class(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("type", "function", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query
def follows_edges(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return _lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.lag("pos").over(w).cast("long").alias("follows")).where("follows IS NOT NULL")


@query
def nearest_instruction(spark, sf_dir):
    b = _classified(spark, sf_dir).select("doc_id", F.lit(0).alias("section_index"), F.col("pos").alias("block_index"), F.concat(F.lit("b"), F.col("pos").cast("string")).alias("id"), "type", "text", "signals", "function", *(F.lit("Overview").alias(c) for c in ("heading", "context")), F.lit("").alias("local_context"))
    return blocks.link(b).where("type = 'code'").select("doc_id", F.col("block_index").cast("long").alias("pos"), F.col("_command.id").alias("command"), F.col("_label.id").alias("label"), F.col("_example.id").alias("example"))


@query
def heading_stack(spark, sf_dir):
    e = _lines(spark, sf_dir).select("doc_id", "pos", F.lit("heading").alias("type"), (F.col("pos") * 7 % 3 + F.length("line") % 3 + 1).cast("int").alias("level"), F.col("line").alias("text"))
    return sections.with_paths(e).select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("path", " > ").alias("path"))


@query
def table_profile(spark, sf_dir):
    """Each document as a table, its lines as rows, their words as cells; explode, unlike a filter, computes the table once."""
    rows = F.transform(F.split("text", "\n"), lambda x: F.split(F.trim(x), " +"))
    one = text.let(tables.parse(rows), lambda t: F.when(t.isNotNull(), F.struct(t["shape"].alias("shape"), tables.profile(t).alias("p"))))
    df = _docs(spark, sf_dir).select("doc_id", F.explode(F.array_compact(F.array(one))).alias("t")).select("doc_id", "t.*")
    return df.select("doc_id", *(F.col(f"shape.{c}").cast("long").alias(c) for c in ("target_cols", "min_cols", "max_cols")), *(F.col(f"p.{c}").cast("long").alias(c) for c in ("row_count", "column_count", "filled_cell_count", "anomaly_count")), F.col("p.cell_density").cast("double").alias("cell_density"))


@query
def table_row_text(spark, sf_dir):
    cells = F.array("c_name", F.trim("c_mktsegment"), F.lit(""), F.col("c_custkey").cast("string"))
    names = tables.headers(F.array(F.lit("Name"), F.lit("Market Segment"), F.lit(""), F.lit("name")))
    return table(spark, sf_dir, "customer").select("c_custkey", tables.row_text(names, cells).alias("row_text"))


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query
def bm25_topk(spark, sf_dir):
    found = retrieval.bm25_top_k(_docs(spark, sf_dir), _queries(spark, sf_dir), 12)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.round("scaled", 5).alias("scaled"), F.col("rank").cast("long").alias("rank"))


def _kind(c):
    return F.when(F.col(c) % 3 == 0, "command").when(F.col(c) % 3 == 1, "flag").otherwise("text")


@query
def keyword_search(spark, sf_dir):
    chunks = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("heading"), F.lit("").alias("context"), F.array(F.lit("guide"), F.col("source")).alias("keywords"), "text", _kind("doc_id").alias("type"))
    asked = _queries(spark, sf_dir).withColumn("query", F.concat(F.when(F.col("query_id") % 10 < 5, "Command ").otherwise("guide "), F.col("query")))
    return retrieval.keyword_search(chunks, asked, 10).select("query_id", F.col("id").alias("doc_id"), "type", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_top_k(e, e.where("vec_id % 100 = 0"), 12).withColumn("score", F.round("score", 6))


@query
def cosine_topk(spark, sf_dir):
    return _nearest(spark, sf_dir).select("query_id", F.col("id").alias("vec_id"), "score")


@query
def minmax_normalise(spark, sf_dir):
    return _nearest(spark, sf_dir).select("query_id", F.col("id").alias("vec_id"), F.round(retrieval.min_max("score", "query_id"), 4).alias("scaled"))


@query
def vector_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "embedding", _kind("vec_id").alias("type"), "vec_id")
    found = retrieval.vector_search(e, e.where("vec_id % 100 = 0"), 12, "id", "embedding")
    return found.select("query_id", "id", "type", F.round("score", 4).alias("score"))


def _two_lists(spark, sf_dir):
    """Two ranked lists of lines for every document with lines, by place: every second line in the first, others and every fourth in the second."""
    lines = _lines(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.concat("line", F.lit("#"), F.col("pos").cast("string")).alias("text"), "pos", _kind("pos").alias("type"))
    w = Window.partitionBy("query_id").orderBy("pos")
    lines = lines.withColumn("rank", F.row_number().over(w))
    vector = lines.where("pos % 2 = 0").select("query_id", "text", "type", (1.0 / (F.col("pos") + 1)).alias("score"), "rank")
    keyword = lines.where("pos % 2 = 1 OR pos % 4 = 0").select("query_id", "text", "type", (1.0 / (F.col("pos") + 2)).alias("score"), "rank")
    return vector, keyword


@query
def weighted_fusion(spark, sf_dir):
    return retrieval.weighted_fusion(*_two_lists(spark, sf_dir)).select("query_id", "text", "type", F.round("score", 6).alias("score"))


@query
def rerank_boost(spark, sf_dir):
    """Every line as a result, with all that the reranker reads, told apart by place and document."""
    pos, doc = F.col("pos"), F.col("doc_id")
    some = lambda c, n, values: F.element_at(F.array(*(F.lit(v) for v in values)), (c % n + 1).cast("int"))
    r = _lines(spark, sf_dir).select(
        doc.alias("query_id"),
        some(doc, 4, ("list the options in that before", "What is the default port", "main command for the build", "alias")).alias("query"),
        F.col("line").alias("text"),
        some(pos, 2, ("Overview", "Default port")).alias("heading"),
        some(pos, 3, ("root", "Build errors", "")).alias("context"),
        some(pos, 5, ("command", "flag", "command_list", "procedure", "text")).alias("type"),
        some(pos, 3, ("note", "text", "config")).alias("subtype"),
        some(pos, 4, ("commands_table", "text", "list", "code")).alias("content_role"),
        some(pos, 2, ("npm run build", "")).alias("command_context"),
        some(pos, 3, ("build", "serve", "")).alias("command"),
        some(doc, 5, ("action", "definition", "explanation", "", None)).alias("intent"),
        (doc % 3 == 0).alias("debug"),
        (doc % 2 == 0).alias("priority"),
        F.when(doc % 7 < 3, F.array(F.lit("command"), F.lit("port"))).when(doc % 7 < 5, F.array(F.lit("flag"))).alias("entities"),
        F.when(doc % 3 == 1, F.array(F.lit(" Build "), F.lit("port"), F.lit(""))).alias("vocab_expansions"),
        F.lit(0.5).alias("score"),
        pos.alias("rank"),
    )
    return retrieval.rerank(r).select("query_id", F.round("boost", 6).alias("boost"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def retrieve_plan(spark, sf_dir):
    vector, keyword = _two_lists(spark, sf_dir)
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("which options of "), F.col("source"), F.lit(" run before")).alias("query"))
    return retrieval.retrieve(vector, keyword, asked).select("query_id", "text", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "fallback")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query
def memory_window(spark, sf_dir):
    return conversation.memory(_messages(spark, sf_dir), 2).select("conv_id", "turn", "role", "text")


@query
def long_term_trigger(spark, sf_dir):
    return conversation.summary_due(_messages(spark, sf_dir)).select("conv_id", "turn", F.col("held").cast("long").alias("held"), "due")


@query
def conversation_state(spark, sf_dir):
    return conversation.states(_messages(spark, sf_dir))


@query
def last_answer(spark, sf_dir):
    return conversation.last_answers(_messages(spark, sf_dir))


@query
def format_history(spark, sf_dir):
    return conversation.formatted(_messages(spark, sf_dir))


@query
def enrich_query(spark, sf_dir):
    return conversation.enriched(_messages(spark, sf_dir))


@query
def context_blocks(spark, sf_dir):
    r = _lines(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.lit("text").alias("type"), F.lit("Overview").alias("heading"), F.lit("root").alias("context"), (0.5 + F.col("pos") / 4).alias("score"), F.col("line").alias("text"), F.col("pos").alias("rank"))
    return conversation.context_blocks(r)


@query
def vector_validity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("row "), F.col("vec_id").cast("string")).alias("text"))
    return validate.valid_pairs(e, "vec_id").select("vec_id")


@query
def drop_report(spark, sf_dir):
    c = _packed(spark, sf_dir)
    return validate.drop_report(c, validate.validate(c))


@query
def token_stats(spark, sf_dir):
    df = _docs(spark, sf_dir).withColumn("tokens", text.tokens("text"))
    return reports.token_stats(df, "source").select("source", *(F.col(c).cast("long").alias(c) for c in ("n", "avg", "median", "min", "max")))


@query
def subtype_counts(spark, sf_dir):
    c = _lines(spark, sf_dir).select(F.explode(chunking.text_pieces(F.col("line"))).alias("p")).select("p.subtype")
    return reports.counts(c, "subtype")


def _markdown(spark, sf_dir):
    """Documents as Markdown: every line whole, as paragraph, list, code, table or below a heading or component that it names; words, numbers and sentence marks only."""
    d = _docs(spark, sf_dir)
    plain = lambda x: F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N}.!?:,]+", " "))
    led = lambda x: F.when(x.rlike("^\\p{L}") & ~x.rlike("^(import|export) "), x).otherwise(F.concat(F.lit("Text "), x))
    lines = F.transform(F.filter(F.transform(F.split("text", "\n"), plain), lambda x: x != ""), led)
    made = F.transform(
        lines,
        lambda x, i: F.when(i % 7 == 0, F.concat(F.when(i % 14 == 0, "## ").otherwise("### "), F.trim(F.substring(x, 1, 30)), F.lit("\n\n"), x))
        .when(i % 7 == 2, F.concat(F.lit("- Run "), x, F.lit("\n- "), x))
        .when(i % 7 == 3, F.concat(F.lit("```sh\nnpm run --flag "), x, F.lit("\n```")))
        .when(i % 7 == 4, F.concat(F.lit("| Name | Value |\n|---|---|\n| a | "), x, F.lit(" |")))
        .when(i % 7 == 5, F.concat(F.lit('<Card title="'), F.trim(F.substring(x, 1, 10)), F.lit('" href={a/b} />\n\n'), x))
        .otherwise(x),
    )
    return d.select("doc_id", F.array_join(made, "\n\n").alias("raw"))


def _sections(spark, sf_dir):
    return sections.document_sections(_markdown(spark, sf_dir).select("doc_id", text.clean_markdown(mdx.normalize_mdx("raw")).alias("text")))


@query
def mdx_normalise(spark, sf_dir):
    return _markdown(spark, sf_dir).select("doc_id", F.md5(mdx.normalize_mdx("raw")).alias("digest"))


@query
def element_counts(spark, sf_dir):
    d = _markdown(spark, sf_dir).select("doc_id", text.clean_markdown(mdx.normalize_mdx("raw")).alias("text"))
    return reports.counts(elements.elements(d), "type")


@query
def section_metadata(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "section_id", "heading", "context", "section_type", "content_role", "command_context", F.array_join("keywords", ",").alias("keywords"), F.md5("text").alias("digest"), F.col("block_count").cast("long").alias("block_count"))


@query
def block_relations(spark, sf_dir):
    return blocks.relations(blocks.link(blocks.blocks(_sections(spark, sf_dir))))


@query
def block_functions(spark, sf_dir):
    return reports.counts(blocks.blocks(_sections(spark, sf_dir)), "type", "function")


@query
def orphan_code(spark, sf_dir):
    return reports.orphan_code(blocks.link(blocks.blocks(_sections(spark, sf_dir))))


@query
def chunk_documents(spark, sf_dir):
    v = validate.validate(chunking.chunks(_sections(spark, sf_dir)))
    return v.select("doc_id", "seq", "chunk_id", "subtype", F.col("tokens").cast("long").alias("tokens"), "score", F.col("rank").cast("long").alias("rank"), F.md5("text").alias("digest"))


@query
def chunk_overlap(spark, sf_dir):
    v = chunking.with_overlap(validate.validate(chunking.chunks(_sections(spark, sf_dir))))
    return v.select("doc_id", F.col("rank").cast("long").alias("rank"), "overlap", F.col("tokens").cast("long").alias("tokens"), F.md5("text").alias("digest"))


def _chunks(spark, sf_dir):
    return validate.validate(chunking.chunks(_sections(spark, sf_dir)))


@query
def chunk_points(spark, sf_dir):
    p = serving.chunk_points(_chunks(spark, sf_dir).withColumn("source", F.concat(F.lit("docs/"), "source", F.lit(".md"))))
    return p.select("id", "file_name", F.col("tokens").cast("long").alias("tokens"), "subtype", F.md5("text").alias("digest"))


@query
def chunk_passages(spark, sf_dir):
    c = serving.passages(_chunks(spark, sf_dir))
    return c.select("doc_id", "seq", F.md5("passage").alias("digest"))


@query
def section_profile(spark, sf_dir):
    p = sections.structure_profile(_sections(spark, sf_dir))
    return p.select("doc_id", "section_id", *(F.col(c).cast("long").alias(c) for c in ("paragraphs", "lists", "tables", "codes", "words")), "role")


@query
def document_texts(spark, sf_dir):
    return sections.document_texts(_sections(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))


@query
def list_blocks(spark, sf_dir):
    """Documents' lines as raw list items, every second document's numbered."""
    items = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.col("doc_id") % 2 == 0, F.concat((i % 9 + 1).cast("string"), F.lit(". "), x)).otherwise(x))
    df = _docs(spark, sf_dir).select("doc_id", sections.parse_list(items).alias("p"), sections.enrich_list(items).alias("e"))
    return df.select("doc_id", F.coalesce(F.col("p.item_count"), F.lit(0)).cast("long").alias("items"), F.coalesce("p.ordered", F.lit(False)).alias("ordered"), F.size("e.items").cast("long").alias("kept"), F.col("e.ordered").alias("kept_ordered"))


@query
def text_helpers(spark, sf_dir):
    path = F.concat(F.lit("a/b/"), "source", F.when(F.col("doc_id") % 3 == 0, ".MD").when(F.col("doc_id") % 3 == 1, ".mdx").otherwise(".txt"))
    cut = text.hard_cut("text", 2400)
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.preview("text")).alias("preview"), text.prefix(F.col("source"), F.lit("Guide")).alias("prefix"), F.size(cut).cast("long").alias("pieces"), F.md5(F.array_join(cut, "|")).alias("cut"), files.doc_type(path).alias("doc_type"), files.file_name(path).alias("file_name"))


@query
def conversation_prompts(spark, sf_dir):
    """The prompt of each conversation: state, history, a context and the last question."""
    m = _messages(spark, sf_dir)
    both = conversation.states(m).join(conversation.formatted(m), "conv_id").join(conversation.last_answers(m), "conv_id")
    asked = m.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("query"))
    df = both.join(asked, "conv_id")
    made = conversation.prompt(F.col("state"), F.col("history"), F.coalesce("answer", F.lit("")), F.lit(""), conversation.state_prefix(F.col("state"), F.col("query")))
    return df.select("conv_id", F.md5(made).alias("prompt"), conversation.needs_rewrite(F.col("query")).alias("rewrite"), conversation.is_confirmation(F.col("query")).alias("confirms"), conversation.guardrail(F.when(F.length("query") % 4 == 0, "irrelevant").when(F.length("query") % 4 == 1, "ambiguous").when(F.length("query") % 4 == 2, "meta")).alias("guard"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
