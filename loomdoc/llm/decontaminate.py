"""Benchmark decontamination by a stored positional inverted index.

The index: documents are dealt to shards of about SHARD_BYTES of text, and for
every word of a shard the list of its places is kept, shard by shard, as a table
in the shared folder. A shard holds whole documents, so all lists that a phrase
needs lie in one row, and a very frequent word is many bounded lists, not one
task's. The corpus-wide frequency of the benchmark's words is read from the
index; it orders every window's words, rarest first. A window's occurrences are
the intersection of its words' lists, each moved by the word's offset, beginning
at the rarest: the rarest word's places are candidates, and each further list
leaves only those that it holds. Words are compared as 64-bit hashes.

Proximity: a window is near where its words stand in order with at most `slack`
other words among them; from a place of the rarest word the nearest place of
each next word, and of each word before, is looked up in that word's list.

The benchmark goes to the workers in blocks of at most `block_chars` characters,
as arrays of hashes (some 30 bytes a word). The index is built once, whatever
the number of blocks; documents are read once.

Texts: A-Z in lower case; words are runs of [0-9A-Za-z] and of any character
beyond U+007F. Null or wordless documents have n_words 0 and are clean; null or
wordless items, or items without an id, have no window. Items or documents given twice count as rows of
their own (an item_id counts once in the items). Ties between equally rare words
go to the earlier offset. Empty tables give no rows, or only clean ones. A
document of any length is one shard at least, tokenised piece by piece. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdoc.llm.common import bound_batches, release_memory
from loomdoc.llm.hashing import WordHashes, runs
from loomdoc.session import written

#: Words in a window.
WINDOW = 10
#: Other words among a near window's own, in the registered query.
SLACK = 2
#: Characters of benchmark text in one block, so what a pass broadcasts has a bound.
BLOCK_CHARS = 8_000_000
#: Bytes of text in a shard of the index, and of text tokenised at once.
SHARD_BYTES, PIECE_BYTES = 2 << 20, 1 << 20
#: Candidate places that are held at once.
CANDIDATES = 500_000
#: Bytes of a row group of the index, which a reader holds whole.
ROW_GROUP = 8 << 20

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_PLACE = (1 << 32) - 1


def tokens(text: bytes | bytearray | None) -> list[bytes]:
    """The words of a UTF-8 text."""
    return bytes(text).translate(_WORD_BYTES).split() if text else []


def token_hashes(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The hashes of a text's words, made piece by piece."""
    if not text:
        return np.zeros(0, np.uint64)
    if len(text) <= PIECE_BYTES:
        return hashes.array(tokens(text))
    clean, parts, at = text.translate(_WORD_BYTES), [], 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE_BYTES)
        end = len(clean) if end < 0 else end
        parts.append(hashes.array(clean[at:end].split()))
        at = end
    return np.concatenate(parts)


# the index


def postings(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """terms, list sizes and places of documents' words; a place counts words of the shard, and one between documents."""
    bases = np.cumsum([0, *(len(h) + 1 for h in docs[:-1])]) if docs else np.zeros(0, np.int64)
    h = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    place = np.concatenate([np.arange(b, b + len(x), dtype=np.int64) for b, x in zip(bases, docs)]) if docs else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    terms, sizes = np.unique(h, return_counts=True)
    return terms, sizes.astype(np.uint32), place[order].astype(np.uint32)


def packed(terms: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Stored form: terms and sizes as they are, places as steps inside a list, compressed."""
    steps = np.diff(places, prepend=np.uint32(0))
    first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    steps[first] = places[first]
    return terms.tobytes(), sizes.tobytes(), pa.compress(steps.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


class Shard:
    """One row of the index, opened."""

    def __init__(self, docs: list[dict], terms: bytes, sizes: bytes, places: bytes):
        self.terms, self.sizes = np.frombuffer(terms, np.uint64), np.frombuffer(sizes, np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        n = int(self.starts[-1])
        steps = np.frombuffer(pa.decompress(places, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint32).astype(np.int64) if n else np.zeros(0, np.int64)
        total = np.cumsum(steps)
        before = np.where(self.starts[:-1] > 0, total[self.starts[:-1] - 1], 0) if n else np.zeros(0, np.int64)
        #: every posting as (place in terms, place), in order
        self.keys = (np.repeat(np.arange(len(self.sizes)), self.sizes) << 32) | (total - np.repeat(before, self.sizes))
        self.bases = np.array([d["base"] for d in docs], np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == keys

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, places, side="right") - 1


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, docs (doc_id, text_hash, base, n_words), terms, sizes and places: the postings of all words of all documents."""
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(f"shard long, docs array<struct<doc_id:{id_type},text_hash:long,base:long,n_words:long>>, terms binary, sizes binary, places binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        hashes = WordHashes()
        shard = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def sealed() -> pa.RecordBatch:
            base, found = 0, []
            for doc_id, text_hash, h in held:
                found.append({"doc_id": doc_id, "text_hash": text_hash, "base": base, "n_words": len(h)})
                base += len(h) + 1
            row = [shard, found, *packed(*postings([h for *_, h in held]))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, out)], schema=out)

        for batch in batches:
            for doc_id, text_hash, text in zip(*(batch.column(k) for k in range(3))):
                text = text.as_py()
                held.append((doc_id.as_py(), text_hash.as_py(), token_hashes(text, hashes)))
                size += len(text or b"") + 64
                if size >= SHARD_BYTES:
                    yield sealed()
                    shard, size = shard + 1, 0
        if held:
            yield sealed()
        hashes = None
        release_memory()

    return rows.mapInArrow(run, schema)


def frequencies(stored: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted terms stands in all documents; reads no places."""
    sent = stored.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        counts = np.zeros(len(asked), np.int64)
        for batch in batches:
            for held, sizes in zip(batch.column(0), batch.column(1)):
                held, sizes = np.frombuffer(held.as_py(), np.uint64), np.frombuffer(sizes.as_py(), np.uint32)
                if len(held):
                    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
                    counts += np.where(held[at] == asked, sizes[at], 0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["k", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in stored.select("terms", "sizes").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.k] = r.n
    return out


# the benchmark


@dataclass
class Block:
    """The distinct windows of a part of the benchmark, as stretches of its words, and the items that hold them."""

    ids: list[str]
    words: np.ndarray  # hashes of all items' words
    first: np.ndarray
    length: np.ndarray
    items: np.ndarray  # of window k: items[item_start[k] : item_start[k + 1]]
    item_start: np.ndarray
    frequency: np.ndarray | None = None  # of each of words


def block_of(items: list[tuple[str, bytes]], size: int = WINDOW) -> Block:
    hashes = WordHashes()
    words, first, length, owner, key, at = [], [], [], [], [], 0
    for k, (_, text) in enumerate(items):
        h = token_hashes(text, hashes)
        if len(h):
            own = runs(h, size)
            words.append(h)
            key.append(own)
            first.append(at + np.arange(len(own)))
            length.append(np.full(len(own), min(size, len(h))))
            owner.append(np.full(len(own), k))
            at += len(h)
    if not words:
        none = np.zeros(0, np.int64)
        return Block([], np.zeros(0, np.uint64), none, none, none, np.zeros(1, np.int64))
    first, length, owner, key = map(np.concatenate, (first, length, owner, key))
    _, some, back = np.unique(key, return_index=True, return_inverse=True)
    pairs = np.unique((back.astype(np.int64) << 32) | owner)
    counts = np.bincount(pairs >> 32, minlength=len(some))
    return Block([i for i, _ in items], np.concatenate(words), first[some].astype(np.int32), length[some].astype(np.int32), (pairs & _PLACE).astype(np.int32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> list[DataFrame]:
    """The benchmark in parts of about block_chars, told apart by a hash of the id."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("item_text")).where("item is not null and item_text is not null")
    chars = items.agg(F.sum(F.length("item_text") + 16)).head()[0] or 0
    n = -(-chars // block_chars) or 1
    return [items.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


# the search


def candidates(shard: Shard, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In bounded parts: windows, their words' places in the shard's terms, those words' order from the rarest, and for every place of the rarest word the row of its window and the place."""
    if not len(shard.terms) or not len(block.words):
        return
    term = np.searchsorted(shard.terms, block.words)
    missing = shard.terms[np.minimum(term, len(shard.terms) - 1)] != block.words
    gone = np.concatenate([[0], np.cumsum(missing)])
    alive = np.flatnonzero(gone[block.first + block.length] == gone[block.first])
    for n in np.unique(block.length[alive]):
        of_n = alive[block.length[alive] == n]
        for lot in np.split(of_n, range(50_000, len(of_n), 50_000)):
            at = block.first[lot][:, None] + np.arange(n)
            order = np.argsort(block.frequency[at], axis=1, kind="stable")
            own = term[at]
            rarest = np.take_along_axis(own, order[:, :1], 1)[:, 0]
            sizes = shard.sizes[rarest]
            lots = np.cumsum(sizes) // CANDIDATES
            for part in np.split(np.arange(len(lot)), np.flatnonzero(np.diff(lots)) + 1):
                row = np.repeat(np.arange(len(part)), sizes[part])
                step = np.arange(len(row)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
                place = shard.keys[shard.starts[rarest[part]][row] + step] & _PLACE
                yield lot[part], own[part], order[part], row, place


def occurrences(shard: Shard, own: np.ndarray, order: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and first places of exact occurrences: the lists' intersection, each moved by its word's offset."""
    first = place - order[row, 0]
    row, first = row[first >= 0], first[first >= 0]
    for j in range(1, order.shape[1]):
        if not len(row):
            break
        offset = order[row, j]
        held = shard.holds((own[row, offset] << 32) | (first + offset))
        row, first = row[held], first[held]
    return row, first


def near(shard: Shard, own: np.ndarray, order: np.ndarray, row: np.ndarray, place: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and first places of windows whose words stand in order among at most `slack` others."""
    n = order.shape[1]
    offset, first, last = order[row, 0], place, place
    for k in range(1, n):
        for way in (1, -1):
            has = (offset + k < n) if way > 0 else (offset - k >= 0)
            some = np.flatnonzero(has)
            if not len(some):
                continue
            term = own[row[some], offset[some] + way * k]
            at = np.searchsorted(shard.keys, (term << 32) | (last[some] + 1 if way > 0 else first[some])) - (way < 0)
            key = shard.keys[np.clip(at, 0, len(shard.keys) - 1)]
            good = (at >= 0) & (at < len(shard.keys)) & (key >> 32 == term)
            first, last = first.copy(), last.copy()
            (last if way > 0 else first)[some] = key & _PLACE
            keep = np.ones(len(row), bool)
            keep[some[~good]] = False
            keep &= last - first < n + slack
            row, offset, first, last = row[keep], offset[keep], first[keep], last[keep]
    same = shard.document(first) == shard.document(last)
    return row[same], first[same]


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches without overlap that cover the same places."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return first[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


def found_in(shard: Shard, block: Block, slack: int) -> Iterator[tuple[int, list[dict], list[str], list[str]]]:
    """document, hit stretches, items and near items of every document of the shard with an occurrence."""
    firsts, ends, hits, close = [], [], [], []

    def pairs(windows: np.ndarray, places: np.ndarray) -> np.ndarray:
        both = np.unique((windows.astype(np.int64) << 32) | shard.document(places))
        windows, docs = both >> 32, both & _PLACE
        counts = block.item_start[windows + 1] - block.item_start[windows]
        step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.unique((np.repeat(docs, counts) << 32) | block.items[np.repeat(block.item_start[windows], counts) + step])

    for windows, own, order, row, place in candidates(shard, block):
        r, first = occurrences(shard, own, order, row, place)
        if len(r):
            a, b = merged(first, first + order.shape[1])
            firsts.append(a)
            ends.append(b)
            hits.append(pairs(windows[r], first))
        if slack:
            r, first = near(shard, own, order, row, place, slack)
            if len(r):
                close.append(pairs(windows[r], first))
    spans: dict[int, list[dict]] = {}
    if firsts:
        a, b = merged(np.concatenate(firsts), np.concatenate(ends))
        docs = shard.document(a)
        for d, x, y in zip(docs.tolist(), (a - shard.bases[docs]).tolist(), (b - a).tolist()):
            spans.setdefault(d, []).append({"first": x, "length": y})
    named: list[dict[int, list[str]]] = [{}, {}]
    for side, lists in zip(named, (hits, close)):
        for p in np.unique(np.concatenate(lists)).tolist() if lists else ():
            side.setdefault(p >> 32, []).append(block.ids[p & _PLACE])
    for d in sorted(named[0].keys() | named[1].keys()):
        yield d, spans.get(d, []), named[0].get(d, []), named[1].get(d, [])


def search(stored: DataFrame, block: Block, slack: int) -> DataFrame:
    """shard, doc, spans, items and near_items of every document with an occurrence of the block's windows."""
    schema = StructType.fromDDL("shard long, doc int, spans array<struct<first:int,length:int>>, items array<string>, near_items array<string>")
    sent = stored.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                number, *parts = (c[k].as_py() for c in batch.columns)
                rows = [(number, *r) for r in found_in(Shard(*parts), sent.value, slack)]
                for at in range(0, len(rows), 1_000):
                    columns = zip(*rows[at : at + 1_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)
        release_memory()

    return stored.select("shard", F.transform("docs", lambda d: F.struct(d["base"].alias("base"))).alias("docs"), "terms", "sizes", "places").mapInArrow(run, schema)


def covered(spans):
    """Words inside any of the spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a, s):
        end = s["first"] + s["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["first"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row: doc_id, text_hash (xxhash64 of the text), n_words, n_hit, spans of hit words, items with occurring windows, near_items (empty without slack)."""
    stored = written(index(docs, id_col, text_col), "postings", **{"parquet.block.size": ROW_GROUP})
    found = None
    for part in blocks(benchmark, item_col, item_text_col, block_chars):
        block = block_of([(r["item"], bytes(r["item_text"])) for r in part.collect()], window)  # at most about block_chars
        terms, back = np.unique(block.words, return_inverse=True)
        block.frequency = frequencies(stored, terms)[back].astype(np.uint32) if len(terms) else None
        here = written(search(stored, block, slack), "found")
        found = here if found is None else found.unionByName(here)
    every = lambda c: F.flatten(F.collect_list(c))
    found = found.groupBy("shard", "doc").agg(every("spans").alias("spans"), F.array_sort(F.array_distinct(every("items"))).alias("items"), F.array_sort(F.array_distinct(every("near_items"))).alias("near_items"))
    rows = stored.select("shard", F.posexplode("docs").alias("doc", "d")).join(found, ["shard", "doc"], "left")
    none = F.array().cast("array<string>")
    return rows.select("d.doc_id", "d.text_hash", "d.n_words", F.coalesce(covered("spans"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.array_sort("spans"), F.array().cast("array<struct<first:int,length:int>>")).alias("spans"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
