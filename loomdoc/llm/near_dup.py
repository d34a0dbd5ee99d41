"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct k-word shingles (A-Z in lower case; with
fewer words, the whole sequence). Sketch: in round i every element is thrown
into one of `size` bins with a random value, and a bin keeps its smallest value
of the earliest round that reached it; after `size` rounds each further round
serves one bin, so by round 2 * size every coordinate is filled. Coordinates of
two sketches agree with the probability of the sets' Jaccard similarity, with
the concentration of independent draws. Bands of `rows` coordinates make
buckets.

Copies of one set are one representative (the smallest id). Buckets are stars
around their smallest member; the stars' components are candidate clusters.
Within a cluster all links between different texts are found by exact set sizes:
members against a few pivots first, then, for members that the pivots leave in
different components, blocks of the smaller components against blocks of all.
Links hold when 100 * intersection >= percent * union. At similarity 0.8 a pair
shares no band with probability (1 - 0.8^rows)^bands = 5e-6, and even then it is
found if its cluster connects it.

Null and wordless texts have empty sets and no links. Null ids are rows of their
own (component null, kept). Rows that share an id count as one document. Equal
similarities need no order: components do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.bloom import SEGMENT_BITS, Filter, build
from loomdoc.llm.common import arrow_batches, map_rows
from loomdoc.llm.components import components
from loomdoc.llm.hashing import WordHashes, lowered_words, mix, runs, seeded
from loomdoc.session import written

#: Coordinates of a sketch and of a band.
SIZE, ROWS = 240, 6
#: Pivots of a cluster.
PIVOTS = 4
#: Bits for each candidate, and most bits, of the filter that keeps other texts out of the shuffle (32 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 28
#: Members and shingles of a block in verification.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Rows and bytes of an Arrow batch while rows carry sets.
BATCH_ROWS, BATCH_BYTES = 500, "8m"
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(runs(hashes.array(lowered_words(text)), k))


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """One row of `size` coordinates for each set; sets must not be empty."""
    out = np.full(len(sets) * size, _FULL, np.uint64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    for i in range(2 * size):
        if not len(elements):
            break
        h = mix(elements ^ seeded(i))
        value = np.uint64(i << 52) | (h >> np.uint64(12))
        bins = (mix(h) % np.uint64(size)).astype(np.int64) if i < size else np.full(len(h), i - size, np.int64)
        np.minimum.at(out, owner * size + bins, value)
        if i % 4 == 3 or i >= size or len(elements) < 50_000:
            open_ = (out.reshape(-1, size) == _FULL).any(axis=1)
            keep = open_[owner]
            elements, owner = elements[keep], owner[keep]
    return out.reshape(-1, size)


def bands(rows_of: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for every band."""
    n, size = rows_of.shape
    parts = rows_of[:, : size // rows * rows].reshape(n, size // rows, rows)
    acc = np.broadcast_to(mix(np.arange(size // rows, dtype=np.uint64) + seeded(7)), (n, size // rows)).copy()
    for j in range(rows):
        acc = mix((acc + parts[:, :, j]) * np.uint64(0x9E3779B97F4A7C15))
    return acc.view(np.int64)


def sketched(docs: DataFrame, k: int, size: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (128 bits of the set), bands."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def start():
        hashes = WordHashes()

        def step(columns: list[list]) -> Iterator[tuple]:
            ids, texts = columns
            sets = [shingle_set(t, k, hashes) for t in texts]
            full = [s for s in sets if len(s)]
            found = iter(bands(sketches(full, size), rows).tolist()) if full else iter(())
            for doc_id, s in zip(ids, sets):
                if len(s):
                    k1 = int(mix(s ^ seeded(101)).sum(dtype=np.uint64).view(np.int64))
                    k2 = int(np.bitwise_xor.reduce(mix(s ^ seeded(102))).view(np.int64))
                    yield doc_id, len(s), k1, k2, next(found)
                else:
                    yield doc_id, 0, None, None, None

        return step

    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("binary")), f"doc_id {id_type}, n_shingles long, k1 long, k2 long, bands array<long>", start, block=400)


def _candidates(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """doc_id, t, cluster and part of the documents in clusters; part numbers the BLOCK-sized parts of a large cluster.

    A Bloom filter of their ids goes ahead of the join, so other texts are not
    shuffled; a filter too full for many ids lets more texts through, no fewer.
    The join is never a broadcast one: the sets follow in Python, and in one
    stage with the sift a task would hold two workers, which stay afterwards.
    """
    segments = min(FILTER_MOST // SEGMENT_BITS, -(-clusters.count() * FILTER_BITS // SEGMENT_BITS) or 1)
    bits = build(clusters.selectExpr("xxhash64(node) AS key", "1 AS level"), segments)
    sent = docs.sparkSession.sparkContext.broadcast(Filter(bits))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = sent.value.levels(b.column(0).to_numpy(), 1) > 0
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(held)) for c in b.columns[1:]], names=["doc_id", "t"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sifted = docs.select(F.xxhash64("doc_id").alias("key"), "doc_id", "t").mapInArrow(sift, f"doc_id {id_type}, t binary")
    large = clusters.groupBy("component").count().where(F.col("count") > BLOCK).select("component", F.ceil(F.col("count") / BLOCK).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("node", F.lit(13)), "parts"), F.lit(0)).cast("int")
    dealt = clusters.join(large, "component", "left").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), part.alias("part"))
    return sifted.join(dealt.hint("merge"), "doc_id").select("doc_id", "t", "cluster", "part")


def _sets(docs: DataFrame, k: int, id_type: str) -> DataFrame:
    """rep, cluster, part, n and the sorted set as bytes, of (doc_id, text, cluster, part) rows."""

    def start():
        hashes = WordHashes()

        def step(columns: list[list]) -> Iterator[tuple]:
            for doc_id, text, cluster, part in zip(*columns):
                s = shingle_set(text, k, hashes)
                yield doc_id, cluster, part, len(s), s.tobytes()

        return step

    return map_rows(docs, f"rep {id_type}, cluster {id_type}, part int, n long, elements binary", start, block=200)


def _pivot_links(sets: DataFrame, percent: int, id_type: str) -> DataFrame:
    """Links between members and their cluster's pivots, which go to every part of the cluster."""
    picks = sets.groupBy("cluster").agg(F.array_distinct(F.array(F.min("rep"), *(F.min(F.struct(F.xxhash64("rep", F.lit(s)), "rep"))["rep"] for s in range(PIVOTS - 1)))).alias("picks"), F.max("part").alias("last"))
    pivots = picks.select("cluster", "last", F.explode("picks").alias("rep")).join(sets.select("rep", "elements"), "rep").groupBy("cluster").agg(F.max("last").alias("last"), F.collect_list(F.struct(F.col("rep").alias("rep"), F.col("elements").alias("elements"))).alias("pivots"))  # at most PIVOTS of a cluster
    pivots = pivots.select("cluster", F.explode(F.sequence(F.lit(0), "last")).alias("part"), "pivots")

    def start():
        def step(columns: list[list]) -> Iterator[tuple]:
            for rep, elements, pivots in zip(*columns):
                s = np.frombuffer(elements, np.uint64)
                for p in pivots:
                    if p["rep"] != rep:
                        q = np.frombuffer(p["elements"], np.uint64)
                        if 100 * min(len(s), len(q)) >= percent * max(len(s), len(q)):
                            both = len(np.intersect1d(s, q, assume_unique=True))
                            if 100 * both >= percent * (len(s) + len(q) - both):
                                yield rep, p["rep"]

        return step

    return map_rows(sets.join(pivots, ["cluster", "part"]).select("rep", "elements", "pivots"), f"a {id_type}, b {id_type}", start, block=200)


def block_links(left: list[tuple], right: list[tuple], percent: int, width: int = 8192) -> Iterator[tuple]:
    """(left id, right id): for each left set one linked right set of every label but its own; rows are (id, label, set)."""
    if not left or not right:
        return
    universe = np.unique(np.concatenate([s for _, _, s in left]))
    sizes = [np.array([len(s) for _, _, s in side], np.int64) for side in (left, right)]
    places = []
    for side in (left, right):
        row = np.repeat(np.arange(len(side)), [len(s) for _, _, s in side])
        e = np.concatenate([s for _, _, s in side])
        at = np.searchsorted(universe, e)
        held = (at < len(universe)) & (universe[np.minimum(at, len(universe) - 1)] == e)
        places.append((row[held], at[held]))
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(universe), width):
        m = []
        for side, (row, at) in zip((left, right), places):
            x = np.zeros((len(side), width), np.float32)
            here = (at >= first) & (at < first + width)
            x[row[here], at[here] - first] = 1
            m.append(x)
        both += m[0] @ m[1].T
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
    for i, j in zip(*np.nonzero(linked)):
        if left[i][1] != right[j][1]:
            yield i, j


def _rest_links(sets: DataFrame, labels: DataFrame, percent: int, id_type: str) -> DataFrame:
    """Links across the labels that pivots left inside one cluster.

    The label with most members is the cluster's main one; members of all others
    meet every member of another label, block by block.
    """
    named = sets.join(labels, F.col("rep") == F.col("node"), "left").select("cluster", "rep", "n", "elements", F.coalesce("component", "rep").alias("label"))
    counts = named.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    shape = counts.groupBy("cluster").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("all_c"), F.sum("s").alias("all_s"), F.max(F.struct("c", "label", "s")).alias("m")).where("labels > 1")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    shape = shape.select("cluster", "main", blocks(F.col("all_c"), F.col("all_s")).alias("nr"), blocks(F.col("all_c") - F.col("m.c"), F.col("all_s") - F.col("m.s")).alias("nl"))
    rows = named.join(shape, "cluster")
    h = lambda by: F.pmod(F.xxhash64("rep", F.lit(11)), F.col(by)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.select("cluster", "rep", "label", "elements", F.lit(False).alias("left"), h("nr").alias("r"), to("nl").alias("l"))
    left = rows.where("label <> main").select("cluster", "rep", "label", "elements", F.lit(True).alias("left"), h("nl").alias("l"), to("nr").alias("r"))

    def verify(table: pa.Table) -> pa.Table:
        sides: dict[bool, list] = {True: [], False: []}
        for rep, label, elements, is_left in zip(*(table.column(c).to_pylist() for c in ("rep", "label", "elements", "left"))):
            sides[is_left].append((rep, label, np.frombuffer(elements, np.uint64)))
        seen: dict[tuple, tuple] = {}
        for i, j in block_links(sides[True], sides[False], percent):
            seen.setdefault((sides[True][i][0], sides[False][j][1]), (sides[True][i][0], sides[False][j][0]))
        a, b = zip(*seen.values()) if seen else ((), ())
        return pa.table({"a": pa.array(a, table.schema.field("rep").type), "b": pa.array(b, table.schema.field("rep").type)})

    return right.unionByName(left).repartition("cluster", "l", "r").groupBy("cluster", "l", "r").applyInArrow(verify, f"a {id_type}, b {id_type}")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, size: int = SIZE, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of docs."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sk = written(sketched(docs, k, size, rows, id_col, text_col), "sketches")
    reps = written(sk.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "reps")
    spread = sk.where("n_shingles > 0").join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("band", "low")
    stars = spread.join(buckets, "band").where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    clusters = written(components(stars), "clusters")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    with arrow_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        sets = written(_sets(_candidates(texts, clusters), k, id_type), "sets")
        first = written(_pivot_links(sets, percent, id_type), "links")
        labels = components(first)
        rest = written(_rest_links(sets, labels, percent, id_type), "links")
    final = labels if rest.isEmpty() else written(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)), "components")
    # rows without a set stay out of the joins, where their null keys would meet in one task
    id_type = sk.schema["doc_id"].dataType
    who = sk.where("n_shingles > 0").select("doc_id", "n_shingles", "k1", "k2").join(reps, ["k1", "k2"], "left").select("doc_id", "n_shingles", "rep")
    found = who.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", "rep", "component")
    found = found.unionByName(sk.where("n_shingles = 0").select("doc_id", "n_shingles", *(F.lit(None).cast(id_type).alias(c) for c in ("rep", "component"))))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
