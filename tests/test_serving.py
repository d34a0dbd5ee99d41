"""End to end over files, the chunk router, vector search with odd input, the store's dimension, and summaries."""

import json

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import chunking, conversation, retrieval, sections, serving
from loomdoc.sources.store import PointStore

WORDS = "The build command makes the site ready and the port option sets where it listens for requests. "
FILES = {
    "a.md": "# Guide\n\n## Build\n\n" + WORDS * 2 + "\n\n```sh\nnpm run build --flag value --other thing --more of it all here now\n```\n",
    "sub/b.mdx": "# Serve\n\nimport x from 'y'\n\n<Note>\n\n" + "Serving files needs a port and a folder, and nothing else is wanted by the server itself. " * 2 + "\n\n</Note>\n",
    "empty.md": " \n",
}


def chunk(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.subtype, r.text) for r in chunking.chunks(sections.document_sections(docs)).orderBy("seq").collect()]


def test_lists_are_steps_first(spark):
    long = "much " * 200
    assert chunk(spark, "- one\n- two") == [("procedure_step", "one"), ("procedure_step", "two")]
    assert chunk(spark, "1. one\n2. two") == [("procedure_step", "one"), ("procedure_step", "two")]
    assert chunk(spark, "- alone") == [("list_item", "alone")]
    assert [k for k, _ in chunk(spark, f"1. short\n2. {long}")] == ["list_item", "list_group"]
    assert [k for k, _ in chunk(spark, f"1. short\n2. {long}\n3. third")] == ["procedure_step"] * 2
    assert chunk(spark, "- one\n* two") == [("list_item", "one"), ("list_item", "two")]


def test_anchors(spark):
    below = "# Top\n## Build\n"
    assert chunk(spark, below + "```\nnpm run build\n```") == [("code_block", "npm run build")]
    assert chunk(spark, below + "Top: do it now") == [("text_atom", "Top\n\n: do it now")]
    assert chunk(spark, below + "Top") == [("text_atom", "Top\n\n")]
    assert chunk(spark, below + "ab") == []


def test_cosine_of_string_ids_mixed_sizes_and_no_queries(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [1.0, 0.0, 0.0]), ("e", None), ("f", []), ("g", [0.0, 0.0]), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, v array<double>")
    got = retrieval.cosine_top_k(v, v.where("id IN ('a', 'd', 'e', 'f')"), 2, "id", "v")
    assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in got.collect()} == {("a", "a", 1.0, 1), ("a", "c", 0.707107, 2), ("d", "d", 1.0, 1)}
    assert retrieval.cosine_top_k(v, v.limit(0), 2, "id", "v").count() == 0
    assert retrieval.cosine_top_k(v.limit(0), v, 2, "id", "v").count() == 0


def test_keyword_search_fills_up_and_ranks_ties_by_id(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", "x y"), ("d", ""), ("e", None)], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "x"), (2, "nothing"), (3, " "), (4, None)], "query_id long, query string")
    got = {(r.query_id, r["rank"]): (r.id, r.scaled) for r in retrieval.bm25_top_k(docs, asked, 3).collect()}
    assert [got[1, k][0] for k in (1, 2, 3)] == ["a", "c", "b"] or got[1, 1][1] == 1.0
    assert [got[2, k] for k in (1, 2, 3)] == [("a", 1.0), ("b", 1.0), ("c", 1.0)]
    assert {q for q, _ in got} == {1, 2}
    assert retrieval.bm25_top_k(docs, asked.limit(0), 3).count() == 0


def test_from_files_to_answers(spark, tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    store = PointStore(spark, f"file://{tmp_path}/points", 32)
    model = retrieval.hashed_model(32)
    failed = serving.ingest(spark, f"{tmp_path}/docs", store, model).collect()
    assert [(r.source.rsplit("/", 1)[1], r._error) for r in failed] == [("empty.md", "empty file")]
    n = store.count()
    serving.ingest(spark, f"{tmp_path}/docs", store, model)
    assert n >= 3 and store.count() == n
    assert {r.file_name for r in store.payloads().collect()} == {"a.md", "b.mdx"}
    asked = spark.createDataFrame([(1, "which port does serving files need", None), (2, "how is the weather", "irrelevant")], "query_id long, query string, intent string")
    found = serving.search(store, asked.drop("intent"), model).where("query_id = 1").orderBy("rank").collect()
    assert "Serving files" in found[0].text
    assert "Serving" not in " ".join(r.text for r in serving.search(store, asked.drop("intent"), model, file="a.md").collect())
    answers = {r.query_id: r.answer for r in serving.ask(store, asked, model, lambda system, user: "It needs a port." if "Serving files" in user else "Unknown.").collect()}
    assert answers == {1: "It needs a port.", 2: "That is outside what these documents cover."}
    with pytest.raises(ValueError, match="32"):
        PointStore(spark, f"file://{tmp_path}/points", 16)
    with pytest.raises(Exception, match="not 32"):
        serving.embedded_queries(asked, retrieval.hashed_model(8), 32).collect()


def test_chunks_as_json_and_settings(spark):
    row = spark.createDataFrame([(" Text ", " H ", None, "s.md", None, 3)], "text string, heading string, context string, source string, subtype string, tokens int")
    made = serving.made_chunk(row)
    d = json.loads(made.select(serving.as_json(made)).head()[0])
    assert (d["text"], d["heading"], d["subtype"], d["order"], d["tokens"], d["source"]) == ("Text", "H", "text", 0, 3, "s.md") and len(d["id"]) == 32
    spark.conf.set("spark.loomdoc.dimension", "64")
    assert serving.Settings.read(spark).dimension == 64
    spark.conf.unset("spark.loomdoc.dimension")


def test_summaries_and_history(spark):
    rows = [("a", k, "user" if k % 2 else "assistant", f"m{k}") for k in range(1, 5)] + [("b", 1, "user", "only")]
    m = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    old = spark.createDataFrame([("a", "old"), ("c", "kept")], "conv_id string, summary string")
    got = {r.conv_id: r.summary for r in conversation.summarised(m, old, lambda system, user: user.split("\n")[0] + " new").collect()}
    assert got == {"a": "Summary so far: new", "b": "", "c": "kept"}

    def fails(system, user):
        raise OSError

    assert {r.conv_id: r.summary for r in conversation.summarised(m, old, fails).collect()}["a"] == "old"
    texts = {r.conv_id: r.history for r in conversation.formatted(m, old).collect()}
    assert texts["c"] == "LONG TERM CONTEXT:\nkept\n\nNo prior conversation." and texts["b"] == "RECENT CONVERSATION:\nUser: only"


def test_lists_as_blocks(spark):
    df = spark.createDataFrame([([" 1. a", "1. a", "x", "", None, "2) bc"],), ([],), (["y"],)], "x array<string>")
    assert [r.p and (r.p["items"], r.p.ordered) for r in df.select(sections.parse_list(F.col("x")).alias("p")).collect()] == [(["1. a", "2) bc"], True), None, None]
    assert [(r.e["items"], r.e.ordered) for r in df.select(sections.enrich_list(F.col("x")).alias("e")).collect()] == [(["1. a", "1. a", "x", "2) bc"], True), ([], False), (["y"], False)]
