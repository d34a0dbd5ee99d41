"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import mdx, signals, tables, text
from loomdoc.operators import components, conversation, elements
from loomdoc.sources.files import doc_type, file_name


def one(spark, column, value=None, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("out")).head()["out"]


def test_cleaner(spark):
    assert one(spark, text.clean_markdown("x"), "![i](u) see [docs](x) <b>ok</b>") == "see docs ok"
    assert one(spark, text.clean_markdown("x"), "a\n**Applies to:** b\n\n\n\n c ") == "a\n\nc"


@pytest.mark.parametrize("path, kind", [("A.MDX", "mdx"), ("a.txt", "unknown"), ("d/x.md", "markdown"), ("x", "unknown")])
def test_file_type(spark, path, kind):
    assert one(spark, doc_type(F.col("x")), path) == kind


def test_file_name(spark):
    assert one(spark, file_name(F.col("x")), "a/b/c.md") == "c.md"
    assert one(spark, file_name(F.col("x")), "") is None


@pytest.mark.parametrize("value, n", [("abc", 1), ("x" * 100, 25), ("", 0), (None, 0)])
def test_tokens(spark, value, n):
    assert one(spark, text.tokens("x"), value) == n


def test_packing(spark):
    parts = [c * n * 4 for c, n in zip("abcd", (100, 150, 90, 300))]
    out = one(spark, text.pack(F.col("x"), 300), parts, "x array<string>")
    assert out == [f"{parts[0]} {parts[1]}", parts[2], parts[3]]
    assert one(spark, text.pack(F.col("x"), 300), [], "x array<string>") == []


def test_sentences_keywords_slug(spark):
    assert one(spark, text.sentences("x"), "One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, text.keywords("x"), "Using Spark with Spark-SQL and ab, port8080 spark") == ["spark", "spark-sql", "port8080"]
    assert one(spark, text.slug("x"), "`Get` Started!") == "get_started"
    assert one(spark, text.slug("x"), "...") == "section"


def test_point_id_is_the_uuid_of_a_sha1(spark):
    import hashlib
    import uuid

    got = one(spark, text.point_id(F.lit("s"), F.lit("h"), F.lit(""), F.lit("t"), F.lit(0), F.col("x")), "body")
    assert got == str(uuid.UUID(bytes=hashlib.sha1(b"s|h||t||body").digest()[:16]))


def test_hard_cut_and_preview(spark):
    assert one(spark, text.hard_cut("x", 3), "abcdefgh") == ["abc", "def", "gh"]
    assert one(spark, text.preview("x", 3), "ab\ncd") == "ab ..."


def test_self_closing_component(spark):
    out = one(spark, mdx.normalize_mdx("x"), 'Hi\n<Card title="A" href={x/y} />\nbye')
    assert '::mdx-component-self name="Card" title="A" href="x/y"' in out


def test_mdx_stages(spark):
    src = 'import X from "x"\nexport const a = {\n  b: 1\n}\n<!-- no -->\n{/* no */}\n<Tabs kind={f(1)}>\nkeep {"lit"} {a.b} {f(x)}\n</Tabs>\n```js\nimport y\n<T a="b"/>\n```'
    out = one(spark, mdx.normalize_mdx("x"), src)
    assert "X from" not in out and "b: 1" not in out and "no" not in out.replace("component", "")
    assert '::mdx-component-open name="Tabs"\n' in out and '::mdx-component-close name="Tabs"' in out
    assert "keep lit a.b" in out
    assert '```js\nimport y\n<T a="b"/>\n```' in out
    assert one(spark, mdx.normalize_mdx("x"), "") == ""


def test_table(spark):
    t = one(spark, tables.parse(F.col("x")), [["Name", "Name", ""], ["---", "---", "---"], ["a", "b", "c"], ["x", "y"]], "x array<array<string>>")
    assert t.headers == ["name", "name_2", "column_3"]
    assert t.cells == [["a", "b", "c"], ["x", "y", ""]]
    assert [a.asDict() for a in t.anomalies] == [{"row_index": 2, "kind": "short_row", "expected_cols": 3, "actual_cols": 2}]
    assert one(spark, tables.parse(F.col("x")), [["", ""]], "x array<array<string>>") is None
    assert one(spark, tables.row_text(F.array(F.lit("name"), F.lit("max_size")), F.array(F.col("x"), F.lit(""))), "a") == "name: a"
    assert one(spark, tables.pipe_row(F.col("x")), "| a | | **c** |") == ["a", "", "c"]


def classify(spark, value, base, ordered=False, heading="Intro"):
    df = spark.createDataFrame([(value,)], "x string").select("x", signals.signals("x").alias("s"))
    where = signals.contexts(F.lit(heading), F.lit(heading), F.lit(""))
    r = df.select("s", signals.function_of(F.lit(base), F.col("x"), F.col("s"), F.lit(ordered), where).alias("f")).head()
    return r.s, (r.f.function, r.f.confidence)


def test_command_signals(spark):
    s, f = classify(spark, "npm install --save foo", "code")
    assert s.has_flags and s.is_command_like and not s.sentence_like
    assert f == ("instruction", 0.88)


def test_functions(spark):
    assert classify(spark, "Run the tool.", "list")[1] == ("instruction", 0.85)
    assert classify(spark, "Run the tool.", "list", True)[1] == ("instruction", 0.90)
    assert classify(spark, "Run the tool.", "text")[1] == ("explanation", 0.70)
    assert classify(spark, "Run the tool.", "text", heading="1. Steps")[1] == ("instruction", 0.78)
    s, f = classify(spark, "Validate: Check that it exists", "text")
    assert s.is_labeled_action and s.label == "Validate" and f == ("instruction", 0.88)
    assert classify(spark, "", "text")[1] == ("mixed", 0.0)


def test_component_text_and_stack(spark):
    props = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("title", "A"), ("href", "x/y"))))
    assert one(spark, components.self_closing_text(F.lit("Card"), props), "") == "Component: Card (href=x/y; title=A)"
    events = [("component_open", n, []) for n in "ABC"] + [("component_close", "B", []), ("component_close", "Z", [])]
    out = one(spark, components.stacks(F.col("x")), events, "x array<struct<type:string,name:string,props:array<struct<key:string,value:string>>>>")
    assert [[f.name for f in s] for s in out] == [["A"], ["A", "B"], ["A", "B", "C"], ["A"], ["A"]]


def test_elements():
    md = "Title\n===\n\npara one\nmore\n\n- a\n- b\nlazy\n\n1. x\n2. y\n\n| A | B |\n|---|---|\n| 1 | 2 |\n\n```sh\n# not a heading\n```\n## Sub ##\n> quoted\n\n---\n::mdx-component-open name=\"T\" k=\"v\""
    got = [(e["type"], e["level"] or e["text"] or e["items"] or e["rows"] or e["name"]) for e in elements.parse(md)]
    assert got == [("heading", 1), ("paragraph", "para one\nmore"), ("list", ["a", "b\nlazy"]), ("list", ["x", "y"]), ("table", [["A", "B"], ["1", "2"]]), ("code", "# not a heading"), ("heading", 2), ("paragraph", "quoted"), ("component_open", "T")]
    assert elements.parse(None) == [] and elements.parse("") == []
    assert [e["type"] for e in elements.parse("```\nopen to the end")] == ["code"]


@pytest.mark.parametrize("q, state", [("this returns an error", "debug"), ("and then", "followup"), ("why", "explanatory"), ("list users", "normal")])
def test_state(spark, q, state):
    assert one(spark, conversation.state_of(F.col("x"), F.lit(False)), q) == state
    assert one(spark, conversation.state_of(F.col("x"), F.lit(True)), q) == "new"


def test_verify_and_prompt(spark):
    assert one(spark, conversation.verified(F.col("x"), F.lit("ok fine")), "draft") == "ok fine"
    assert one(spark, conversation.verified(F.col("x"), F.lit("")), "draft") == "draft"
    assert one(spark, conversation.verified(F.col("x"), F.lit("Not enough information to answer that")), "draft") == conversation.REFUSAL
    assert one(spark, conversation.is_confirmation(F.col("x")), " Really ") is True
    assert "Question:\nq" in one(spark, conversation.prompt(F.lit("debug"), F.lit(""), F.lit("c"), F.lit(None), F.col("x")), "q")
