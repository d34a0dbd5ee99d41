"""Whole plans: sections, relations, chunks, retrieval, store, streams and every registered query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomdoc.functions.text import tokens
from loomdoc.operators import blocks, chunking, elements, reports, retrieval, sections, validate
from loomdoc.plans import registry
from loomdoc.sources.store import PointStore

MD = "# A\nintro text here\n## B\n1. Run the tool.\n\n```sh\nnpm i -g x\n```\n### C\nsome words\n## D\n| Name | Value |\n|---|---|\n| a | b |\n"


@pytest.fixture(scope="module")
def parsed(spark):
    return elements.elements(spark.createDataFrame([("d", MD)], "doc_id string, text string")).cache()


def test_heading_stack(parsed):
    rows = sections.with_paths(parsed).where("type = 'heading'").orderBy("pos").collect()
    assert [r.path for r in rows] == [[], ["A"], ["A", "B"], ["A"]]


def test_sections(parsed):
    rows = sections.sections(parsed).orderBy("section_order").collect()
    assert [r.section_id for r in rows] == ["s0_a", "s1_b", "s2_c", "s3_d"]
    assert rows[1].section_type == "code" and rows[3].section_type == "structured"
    assert rows[1].text == "1. Run the tool.\n\nnpm i -g x" and rows[2].context == "A > B"


def test_relations(parsed):
    linked = blocks.link(blocks.blocks(sections.sections(parsed))).cache()
    edges = {(r.src, r.dst, r.type, r.confidence) for r in blocks.relations(linked).collect()}
    assert edges == {("d:s1_b:b1", "d:s1_b:b0", "follows", 0.55), ("d:s1_b:b1", "d:s1_b:b0", "implements", 0.88)}
    code = linked.where("type = 'code'").head()
    assert code.parent_instruction == "Run the tool." and "Parent instruction: Run the tool." in code.retrieval_text
    assert reports.orphan_code(linked).head().orphans == 0


def test_chunks_hold_their_invariants(spark, sf):
    v = validate.validate(chunking.chunks(registry._sections(spark, sf))).cache()
    assert v.where(f"tokens < 10 OR tokens > {validate.MOST}").count() == 0
    assert v.groupBy("doc_id", validate.dedupe_key(F.col("text"))).count().where("count > 1").count() == 0
    assert v.count() > 0


def test_chunks_over_their_limit(spark):
    """A heading that rounding packs with its list stays apart; packed sentences stay together; a list without heading goes by sentences."""
    head, bare, packed, listed = "h" * 30, "w " * 785 + "an", "ab! " * 299 + "ab!" + " x" * 250, "An item. " * 200
    rows = [("a", 0, f"{head}\n\n{bare}", "list_group", ["list"], [head]), ("a", 1, "next", "list_item", ["list"], [head]), ("b", 0, packed, "text_split", ["table"], []), ("c", 0, listed.strip(), "list_group", ["list"], [])]
    df = spark.createDataFrame(rows, "doc_id string, seq long, text string, subtype string, content_types array<string>, heading_path array<string>")
    cut = chunking.enforce_limit(df.withColumn("split_part", F.lit(None).cast("int")).withColumn("tokens", tokens("text"))).orderBy("doc_id", "seq").collect()
    assert [(r.seq, r.text, r.split_part) for r in cut if r.doc_id == "a"] == [(0, f"{head}\n\n", 0), (1, f"{head}\n\n{bare}", 1), (2, "next", None)]
    assert [(r.text, r.split_part) for r in cut if r.doc_id == "b"] == [(packed, 0)]
    assert [r.text for r in cut if r.doc_id == "c"] == ["An item."] * 200


def test_equal_scores_rank_in_order(spark):
    """Sums of the same tenths in another order are one score."""
    five, six = " ".join(["w" * 70] * 5), "some six words of a list " * 4
    rows = [("d", 0, six, 25), ("d", 1, five, 88)]
    df = spark.createDataFrame(rows, "doc_id string, seq long, text string, tokens int").select("*", F.lit("list_item").alias("subtype"), F.array(F.lit("list")).alias("content_types"))
    assert [(r.seq, r.score) for r in validate.validate(df).orderBy("rank").collect()] == [(0, 1.7), (1, 1.7)]


def test_score_and_sizes(spark):
    t = "word " * 60 + ": end of it"
    r = spark.createDataFrame([(t,)], "x string").select(validate.score(F.lit(100), F.lit("code_block"), F.array(F.lit("code")), F.col("x")).alias("s"), *(validate.right_size(F.lit(n), F.lit(k)).alias(f"{k}{n}") for n, k in ((15, "text_atom"), (15, "table_row"), (801, "text"))))
    assert tuple(r.head()) == (7.0, False, True, False)


@pytest.mark.parametrize("types, out", [(["code"], "high"), (["list"], "medium"), (["paragraph"], "low"), (["code", "paragraph"], "medium"), ([], "low")])
def test_density(spark, types, out):
    assert spark.createDataFrame([(types,)], "x array<string>").select(chunking.density(F.col("x"))).head()[0] == out


def test_min_max(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 1.0), (1, 0.0), (2, 5.0), (2, 5.0)], "q int, s double")
    assert sorted(r[0] for r in df.select(retrieval.min_max("s", "q")).collect()) == [0.0, 0.5, 1.0, 1.0, 1.0]


def test_fusion(spark):
    v = spark.createDataFrame([(1, "A", "text", 1.0, 1), (1, "B", "text", 0.0, 2)], "query_id int, text string, type string, score double, rank int")
    k = spark.createDataFrame([(1, "B", "text", 1.0, 1)], v.schema)
    assert {r.text: r.score for r in retrieval.weighted_fusion(v, k).collect()} == {"A": 1.0, "B": 0.2}
    assert [r.text for r in retrieval.reciprocal_rank_fusion(v, k).orderBy("rank").collect()] == ["B", "A"]


def test_store(spark, tmp_path):
    s = PointStore(spark, f"file://{tmp_path}/points", 3)
    points = spark.createDataFrame([("1", [1.0, 0.0, 0.0], "old", "f.md", 1), ("1", [0.0, 1.0, 0.0], "new", "f.md", 2), ("2", [1.0], "short", "g.md", 1)], "id string, vector array<float>, text string, file_name string, version int")
    s.upsert(points, "version")
    assert [(r.id, r.text) for r in s.read().collect()] == [("1", "new")]
    s.upsert(points.where("version = 1").withColumn("text", F.lit("newer")))
    assert s.payloads("f.md").head().text == "newer" and s.payloads("x").count() == 0 and "vector" not in s.payloads().columns
    s.reset()
    assert s.count() == 0


def test_ingest_stream(spark, tmp_path):
    from loomdoc.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n" + "These are plain words that fill the paragraph. " * 6)
    got = []
    q = ingest_stream(spark, f"{tmp_path}/in", lambda df, n: got.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert len(got) == 1 and got[0].subtype == "text_atom"


def test_embedder(spark):
    df = spark.createDataFrame([("a b",), (None,)], "passage string")
    out = [r.vector for r in retrieval.embed(df, retrieval.hashed_model(16)).collect()]
    assert all(len(v) == 16 for v in out) and abs(sum(x * x for x in out[0]) - 1) < 1e-5


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("customer", "documents", "embeddings", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = registry.queries()[name](spark, sf).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype({c: str for c in cols}).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A document with packed sentences and a list just above their limits."""
    path = f"{tmp_path_factory.mktemp('odd')}"
    lines = ["Anchor of thirty letters in all and more words", "one", "two", "three", "erer. " * 700, "five", "six", "Second heading of the text here", "eight", "ab " * 523 + "an", "ten"]
    spark.createDataFrame([(1, "\n".join(lines), "web")], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["chunk_points", "chunk_passages"])
def test_chunks_at_their_limit_equal_the_sql(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    a, b = registry.queries()[name](spark, odd).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert len(a) > 0 and sorted(a.astype(str)[sorted(a)].values.tolist()) == sorted(b.astype(str)[sorted(a)].values.tolist())


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """A paragraph and list items above their limits that begin with their parent heading twice."""
    path = f"{tmp_path_factory.mktemp('repeated')}"
    twice = "Spam and eggs " * 2
    lines = ["Spam and eggs", *["line"] * 6, "Next heading", f"{twice}{'ab ' * 800}", f"{twice}{'cd ' * 600}", "code", twice + "ef " * 600, "x", twice + "gh " * 900]
    spark.createDataFrame([(1, "\n".join(lines), "web")], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_parts_that_begin_with_their_heading_equal_the_sql(spark, repeated):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{repeated}/documents.parquet/*.parquet'")
    a, b = registry.queries()["chunk_passages"](spark, repeated).toPandas(), con.sql(registry.oracle_sql()["chunk_passages"]).df()
    assert len(a) > 4 and sorted(a.astype(str)[sorted(a)].values.tolist()) == sorted(b.astype(str)[sorted(a)].values.tolist())


@pytest.mark.parametrize("name", ["chunk_points", "chunk_passages"])
def test_a_lone_import_keeps_what_follows(spark, tmp_path, name):
    """An import of one line goes; the word alone on its line takes no later line with it."""
    lines = ["import", "import all the words of this line and many more until it is long enough to be kept. " * 2, "three", "four", "five", "six", "seven", "import", "import", "The list item after a lone import, long enough for a chunk of its own and still short. " * 2]
    spark.createDataFrame([(1, "\n".join(lines), "web")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    a, b = registry.queries()[name](spark, f"{tmp_path}").toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert len(b) > 2 and sorted(a.astype(str)[sorted(a)].values.tolist()) == sorted(b.astype(str)[sorted(a)].values.tolist())


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
