"""Vector and keyword retrieval, score fusion and reranking."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomdoc.functions.text import join_present, split_words, strip
from loomdoc.session import dropped, written

#: BM25 constants: term saturation, length share, and the share of the mean that a negative idf becomes.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries that one pass over the vectors or documents carries.
QUERY_BLOCK = 4_096
#: Parts that the candidates of one query are ranked in first.
SALTS = 32


def top_k(df: DataFrame, by: str, order: list[Column], k: int, salts: int = SALTS) -> DataFrame:
    """The first k rows of each `by` with their rank; ranked in parts first, so no task holds all of a query's rows."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k).drop("_salt")


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 12, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score and rank of each query's k nearest vectors by cosine.

    Queries go out in blocks; a task keeps k candidates of each query while it
    reads. Null and empty vectors are left out, and a query meets vectors of its
    own size alone; a zero vector scores 0; equal scores rank by id. Ids may be of
    any type that orders. No queries give no rows.
    """
    rows = queries.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).alias("q"), F.col(vector_col).alias("v"))
    q_type = queries.schema[id_col].dataType.simpleString()
    out = None
    n = rows.count()
    parts = -(-n // block) or 1
    for part in range(parts):
        held = rows.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).collect() if parts > 1 else rows.collect()  # about `block` rows
        found = _block_top_k(vectors, [(r["q"], r["v"]) for r in held], k, id_col, vector_col, q_type)
        out = found if out is None else out.unionByName(found)
    return top_k(out, "query_id", [F.desc("score"), F.col("id")], k)


def best_columns(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of at least the k largest scores of every row, all columns that equal the k-th among them."""
    if score.shape[1] <= k:
        return np.nonzero(np.ones(score.shape, bool))
    floor = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return np.nonzero(score >= floor[:, None])


def _block_top_k(vectors: DataFrame, queries: list[tuple], k: int, id_col: str, vector_col: str, q_type: str) -> DataFrame:
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(v) for _, v in queries}:
        ids, rows = zip(*((q, v) for q, v in queries if len(v) == size))
        m = np.array(rows, np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        by_size[size] = list(ids), np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    sent = vectors.sparkSession.sparkContext.broadcast(by_size)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[tuple[float, object]]]] = {size: [[] for _ in ids] for size, (ids, _) in sent.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                found, every = part.column(0).to_pylist(), part.column(1).to_pylist()
                for size, (ids, matrix) in sent.value.items():
                    keep = [i for i, v in enumerate(every) if v is not None and len(v) == size and found[i] is not None]
                    if not keep:
                        continue
                    v = np.array([every[i] for i in keep], np.float64)
                    length = np.linalg.norm(v, axis=1)
                    score = np.round(matrix @ np.divide(v, length[:, None], out=np.zeros_like(v), where=length[:, None] > 0).T, 12)
                    new: list[list[tuple[float, object]]] = [[] for _ in ids]
                    for q, c in zip(*best_columns(score, k)):
                        new[q].append((-float(score[q, c]), found[keep[c]]))
                    held[size] = [sorted(old + own)[:k] for old, own in zip(held[size], new)]
        rows = [(q, i, -s) for size, (ids, _) in sent.value.items() for q, best in zip(ids, held[size]) for s, i in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["query_id", "id", "score"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"query_id {q_type}, id {id_type}, score double")


def min_max(score: str, by: str) -> Column:
    """Scores of each `by` from 0 to 1; all 1 where they are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))


def vector_boost(kind: Column) -> Column:
    return F.when(F.lower(kind) == "flag", 0.15).when(F.lower(kind) == "command", 0.10).otherwise(0.0)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", type_col: str = "type") -> DataFrame:
    """query_id, id, type, score and rank: the k nearest, their cosines scaled from 0 to 1 for each query, with the boost of their type."""
    found = cosine_top_k(vectors, queries, k, id_col, vector_col)
    kinds = vectors.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(type_col), F.lit(""))).alias("type"))
    return found.withColumn("score", min_max("score", "query_id")).join(kinds, "id").select("query_id", "id", "type", (F.col("score") + vector_boost(F.col("type"))).alias("score"), "rank")


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "chunk_id", query_col: str = "query_id", query_text_col: str = "query") -> DataFrame:
    """query_id, id, type, score and rank of the k best chunks by heading, context, command context, keywords and text, scaled and boosted by type."""
    have = lambda c, t: F.col(c) if c in chunks.columns else F.lit(None).cast(t)
    text = search_text(*(have(c, "string") for c in ("heading", "context", "command_context")), have("keywords", "array<string>"), have("text", "string"))
    kinds = chunks.select(F.col(id_col).alias("id"), F.lower(F.coalesce(have("type", "string"), F.lit(""))).alias("type"))
    found = bm25_top_k(chunks.select(F.col(id_col).alias("id"), text.alias("search")), queries, k, "id", "search", query_col, query_text_col)
    asked = queries.select(F.col(query_col).alias("query_id"), F.col(query_text_col).alias("_query"))
    both = found.join(kinds, "id").join(asked, "query_id")
    return both.select("query_id", "id", "type", (F.col("scaled") + keyword_boost(F.col("_query"), F.col("type"))).alias("score"), "rank")


def search_text(heading: Column, context: Column, command_context: Column, keywords: Column, text: Column) -> Column:
    """What keyword search reads of a chunk."""
    return strip(join_present([heading, context, command_context, F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "), text], " "))


def bm25_top_k(corpus: DataFrame, queries: DataFrame, k: int = 12, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text_col: str = "query", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, scaled and rank of each query's k best documents; equal scores rank by id.

    Document frequencies are one count of all terms. Then queries go out in
    blocks with the weights of their terms, and a task keeps k candidates of each
    while it reads its documents, so common words make no rows. Documents without
    a word are no documents; those without a term of the query score 0 and fill a
    list of fewer than k (terms rarer than the mean have positive weights, so no
    match ranks below them unless the mean idf is negative). scaled is from 0 to 1 over all documents. Queries
    without a word give no rows.
    """
    words = lambda c: split_words(F.lower(c))
    docs = corpus.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).where((F.size("w") > 0) & F.col("id").isNotNull())
    asked = queries.select(F.col(query_col).alias("query_id"), words(F.col(query_text_col)).alias("w")).where(F.size("w") > 0)
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean")).head()
    n, mean = size["n"] or 0, size["mean"] or 1.0
    df = docs.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = written(df.select("term", idf.alias("idf")), "term-weights")
    floor = (rated.agg(F.avg("idf")).head()[0] or 0.0) * EPSILON
    q_type, id_type = queries.schema[query_col].dataType.simpleString(), corpus.schema[id_col].dataType.simpleString()
    out = None
    parts = -(-asked.count() // block) or 1
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else asked
        lists = [(r["query_id"], r["w"]) for r in some.collect()]  # about `block` rows
        terms = some.select(F.explode("w").alias("term")).distinct()
        weight = {r["term"]: floor if r["idf"] < 0 else r["idf"] for r in rated.join(terms, "term", "left_semi").toLocalIterator()}
        found = _block_bm25(docs, lists, weight, mean, k, q_type, id_type)
        out = found if out is None else out.unionByName(found)
    dropped(rated)
    bounds = out.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = top_k(out.where("id IS NOT NULL").select("query_id", "id", "score"), "query_id", [F.desc("score"), F.col("id")], k)
    scaled = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return best.join(bounds, "query_id").select("query_id", "id", "score", scaled.alias("scaled"), "rank")


def _block_bm25(docs: DataFrame, queries: list[tuple], weight: dict[str, float], mean: float, k: int, q_type: str, id_type: str) -> DataFrame:
    """A task's candidates of each query, with the least and largest score of its documents."""
    by_term: dict[str, list[tuple[int, float]]] = {}
    for q, (_, w) in enumerate(queries):
        for term, times in Counter(w).items():
            if term in weight:
                by_term.setdefault(term, []).append((q, times * weight[term] * (K1 + 1)))
    sent = docs.sparkSession.sparkContext.broadcast((by_term, [q for q, _ in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term, ids = sent.value
        held: list[list[tuple[float, object]]] = [[] for _ in ids]
        least, most, matched = [math.inf] * len(ids), [-math.inf] * len(ids), [0] * len(ids)
        first: list = []  # the task's least ids: among 2k of them, k share no term with a query that matches fewer than k
        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                own, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                total += len(own)
                first = heapq.nsmallest(2 * k, [*first, *own])
                new: list[list[tuple[float, object]]] = [[] for _ in ids]
                for i, words in zip(own, texts):
                    scores: dict[int, float] = {}
                    share = K1 * (1 - B + B * len(words) / mean)
                    for term, tf in Counter(w for w in words if w in by_term).items():
                        for q, x in by_term[term]:
                            scores[q] = scores.get(q, 0.0) + x * tf / (tf + share)
                    for q, s in scores.items():
                        matched[q] += 1
                        least[q], most[q] = min(least[q], s), max(most[q], s)
                        if len(held[q]) < k or s >= -held[q][-1][0]:
                            new[q].append((-s, i))
                held = [sorted(old + more)[:k] if more else old for old, more in zip(held, new)]
        rows = []
        for q, name in enumerate(ids):
            others = total > matched[q]
            lo, hi = (min(least[q], 0.0), max(most[q], 0.0)) if others else (least[q], most[q])
            mine = {i for _, i in held[q]}
            zeros = [(0.0, i) for i in first if i not in mine][:k] if others and matched[q] < k else []
            if total:
                rows += [(name, i, -s, lo, hi) for s, i in sorted(held[q] + zeros)[:k]] or [(name, None, 0.0, lo, hi)]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    schema = StructType.fromDDL(f"query_id {q_type}, id {id_type}, score double, lo double, hi double")
    out = to_arrow_schema(schema)
    return docs.select("id", "w").mapInArrow(run, schema)


def keyword_boost(query: Column, kind: Column) -> Column:
    q, k = F.lower(query), F.lower(F.coalesce(kind, F.lit("")))
    return F.when(q.rlike("command|cli"), F.when(k == "command", 0.8).when(k == "flag", -0.3).otherwise(0.0)).otherwise(F.when(k == "command", 0.4).when(k == "flag", 0.1).otherwise(0.0))


def weighted_fusion(vector: DataFrame, keyword: DataFrame, weights: tuple[float, float] = (1.0, 0.2)) -> DataFrame:
    """Results of both kinds (query_id, text, type, score, rank and more) as one for each query and text.

    Scores add up by weight; other columns are the first row's, vector before
    keyword, by rank. Where two or more of a query's first five vector results
    are commands, only commands stay among its keyword results.
    """
    mode = vector.where("rank <= 5").groupBy("query_id").agg((F.count_if(F.lower("type") == "command") >= 2).alias("_commands"))
    keyword = keyword.join(mode, "query_id", "left").where(~F.coalesce("_commands", F.lit(False)) | (F.lower("type") == "command")).drop("_commands")
    both = vector.withColumn("_side", F.lit(0)).withColumn("_w", F.lit(weights[0])).unionByName(keyword.withColumn("_side", F.lit(1)).withColumn("_w", F.lit(weights[1])))
    rest = [c for c in vector.columns if c not in ("query_id", "text", "score", "rank")]
    first = F.min_by(F.struct(*rest), F.struct("_side", "rank")) if rest else F.lit(None)
    out = both.groupBy("query_id", "text").agg(F.sum(F.col("_w") * F.col("score")).alias("score"), F.min(F.struct("_side", "rank")).alias("_order"), first.alias("_rest"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_order", "text")))
    return out.select("query_id", "text", "score", "rank", *(F.col("_rest")[c].alias(c) for c in rest))


def reciprocal_rank_fusion(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Published reciprocal rank fusion of (query_id, text, rank) lists."""
    both = lists[0].select("query_id", "text", "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select("query_id", "text", "rank"))
    out = both.groupBy("query_id", "text").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "text")))


# Word lists and weights of the reranker. Where a list is matched by
# substring, an entry that holds another one is left out, since it matches nowhere else.
CORE = ("dev", "build", "start")
BEHAVIOUR = ("alias", "default", "without", "before", "after", "warning", "recommended", "optional", "required", "good", "know", "what happens")
LISTING = ("list", "available", "all commands", "all options", "provide commands")
COMMAND, FLAG, MAIN = ("command", "cli"), ("flag", "option", "parameter"), ("main", "core", "basic", "primary")
PHRASES = ("without a command", "good to know", "default port", "alias for", "before", "after")
QUERY_STOPS = ("what", "is", "the", "when", "you", "run", "a", "an", "to", "do", "does", "of", "and", "in", "for", "on", "with", "without", "are")
TROUBLE = ("error", "fail", "issue", "debug")
NOTES = ("note", "config", "concept")
OVERLAP = (("heading", 1.2), ("context", 0.8), ("text", 1.0), ("command_context", 1.0))


def query_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_.-]+)"), 1)


def rerank_boost() -> Column:
    """The boost of a result row.

    Reads query, heading, context, text, type, subtype, content_role,
    command_context, command, and the query's intent, debug, priority, entities
    and vocab_expansions; and its words and the columns' tokens, which rerank
    makes once (_words, _tokens).
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    q = strip(low("query"))
    kind, sub, role, intent, command = low("type"), low("subtype"), low("content_role"), strip(low("intent")), strip(low("command"))
    blob = strip(F.concat_ws(" ", low("heading"), low("context"), low("text"), low("command_context")))
    has = lambda c, some: F.exists(F.array(*map(F.lit, some)), lambda p: F.contains(c, p))
    words = F.col("_words")
    held = lambda c: F.col("_tokens")[[x for x, _ in OVERLAP].index(c)]
    shared = lambda c: 0.12 * F.size(F.filter(words, lambda w: F.array_contains(held(c), w)))
    anywhere = 0.12 * F.size(F.filter(words, lambda w: F.exists("_tokens", lambda t: F.array_contains(t, w))))
    when = lambda condition, value: F.when(condition, value).otherwise(0.0)
    commands, flags, behaviour = has(q, COMMAND), has(q, FLAG), has(q, BEHAVIOUR)
    entities = F.coalesce(F.col("entities"), F.array().cast("array<string>"))
    expansions = F.filter(F.transform(F.coalesce(F.col("vocab_expansions"), F.array().cast("array<string>")), lambda v: strip(F.lower(F.coalesce(v, F.lit(""))))), lambda v: v != "")
    terms = [
        when((q != "") & F.contains(blob, q), 1.0),
        0.35 * F.size(F.filter(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(blob, p))),
        *(shared(c) * w for c, w in OVERLAP),
        F.when(commands, F.when(kind == "command", 0.65).when(kind == "flag", -0.25).otherwise(0.0)).when(flags, F.when(kind == "flag", 0.75).when(kind == "command", -0.15).otherwise(0.0)).otherwise(F.when(kind == "command", 0.12).when(kind == "flag", 0.05).otherwise(0.0)),
        when(has(q, LISTING), F.when((role == "commands_table") | (kind == "command_list"), 0.9).when(kind == "command", 0.35).otherwise(0.0)),
        when(behaviour & sub.isin(*NOTES), 0.85),
        when(behaviour & kind.isin("command_list", "command_options", "command_examples"), 0.45),
        when(behaviour & (kind == "command"), -0.15),
        when(behaviour & (kind == "flag"), -0.10),
        when(commands & (command != ""), F.when(command.isin(*CORE), 0.35).when(has(q, MAIN), -0.35).otherwise(0.0)),
        when(F.array_contains(entities, "command") & (kind == "command"), 0.18),
        when(F.array_contains(entities, "flag") & (kind == "flag"), 0.18),
        when(F.array_contains(entities, "port") & F.contains(blob, F.lit("port")), 0.22),
        0.08 * F.size(F.filter(expansions, lambda v: F.contains(blob, v))),
        when((intent == "action") & kind.isin("procedure", "command_examples", "command_options"), 0.25),
        when((intent == "definition") & sub.isin(*NOTES), 0.25),
        when((intent == "definition") & kind.isin("command_list", "command_options"), 0.18),
        when((intent == "explanation") & sub.isin(*NOTES), 0.22),
        when(F.coalesce(F.col("debug"), F.lit(False)) & has(blob, TROUBLE), 0.35),
        when(F.coalesce(F.col("priority"), F.lit(False)) & (kind == "command"), 0.20),
        when(F.coalesce(F.col("priority"), F.lit(False)) & (role == "commands_table"), 0.15),
        when((F.size(words) >= 3) & (anywhere < 0.12), -0.25),
        when((F.size(split_words(blob)) > 180) & ~sub.isin(*NOTES), -0.05),
    ]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


RERANK_COLUMNS = {"heading": "string", "context": "string", "type": "string", "subtype": "string", "content_role": "string", "command_context": "string", "command": "string", "intent": "string", "debug": "boolean", "priority": "boolean", "entities": "array<string>", "vocab_expansions": "array<string>"}


def rerank(results: DataFrame) -> DataFrame:
    """Results (query_id, query, text, score, rank) with their boost added, ranked anew; equal scores keep their order."""
    full = results.select("*", *(F.lit(None).cast(t).alias(c) for c, t in RERANK_COLUMNS.items() if c not in results.columns))
    full = full.withColumn("_words", F.filter(query_tokens(strip(F.lower(F.coalesce("query", F.lit(""))))), lambda w: ~w.isin(*QUERY_STOPS)))
    full = full.withColumn("_tokens", F.array(*(query_tokens(F.col(c)) for c, _ in OVERLAP)))
    scored = full.withColumn("boost", rerank_boost()).withColumn("score", F.col("score") + F.col("boost"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).select(*results.columns, "boost")


def retrieve(vector: DataFrame, keyword: DataFrame, queries: DataFrame, fused: int = 6, final: int = 5, least: float = 0.25) -> DataFrame:
    """Fusion, its first rows, reranking, the final rows; `fallback` marks queries whose best score is below `least`."""
    first = weighted_fusion(vector, keyword).where(F.col("rank") <= fused).join(queries, "query_id")
    ranked = rerank(first)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("fallback", best < least).where(F.col("rank") <= final)


def embed(df: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "passage", out: str = "vector", prefix: str = "passage: ") -> DataFrame:
    """Vectors of a text column by a model that each worker loads once; unit length."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for s in batches:
            v = np.array(encode([f"{prefix}{t or ''}" for t in s]), np.float64).reshape(len(s), -1)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list((v / np.where(n > 0, n, 1)).astype(np.float32)))

    return df.withColumn(out, run(F.col(text_col)))


def hashed_model(dimension: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A model that needs no files: signed hashes of words."""

    def load():
        import zlib

        def encode(texts: list[str]) -> list[list[float]]:
            out = np.zeros((len(texts), dimension))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dimension] += 1 if h >> 31 else -1
            return out.tolist()

        return encode

    return load
