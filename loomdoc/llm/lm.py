"""Language-model scoring with a log-frequency Bloom filter.

Counting: every training document's words and pairs of neighbouring words (an
end closes each text) are counted by hash, first in the task, then by a shuffle;
none is left out, nor one counted once. The filter holds, for every n-gram of
quantised level L (L - 1 < log2 count + 1 <= L), the keys (n-gram, 1) to
(n-gram, L); a count is read back by probing level after level until one is
missing, and stands for the mean count of its level. The filter is built by
segments in the executors and has as many bits as half filling needs, whatever
the corpus. Up to MODEL_BITS it is broadcast; beyond, it stays in the executors:
texts are packed to chunks, each chunk's n-grams are joined with the parts of the
filter that they fall into, and the levels found come back to the chunk. Both
ways read the same bits, so they give the same scores.

A token's probability is p (w r + 1 - w): p the word's smoothed probability, r
the pair's relative frequency over p, kept to an eighth of an octave, and w a
weight for the level of the word before. One pass over the texts probes the
filter and leaves, for each text, the sum of log p and the codes of (level, r);
on training texts it counts the codes once more, with each occurrence left out
of its own counts. From the latter of all training documents come the weights
that maximise their likelihood, and from the former then the scores, without a
second look at texts or filter.

The base score needs each word's exact count: frequent words (at most HEAD of
them) go along with the code, all others are joined by hash.

Words: runs of anything but space and U+0009 to U+000D, A-Z in lower case. A
null text is empty: one token, the end. Null ids count as training rows. Repeated
rows are scored, and counted, each for itself. An empty table gives no rows; other
columns are ignored. Without training rows N = V = 0 and base_score is
tokens * log10(0.1 / 0.1). Hashes have 63 bits.
"""

from __future__ import annotations

import copy
import gc
import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.bloom import K_FIRST, K_NEXT, SEGMENT_BITS, Filter, build, build_parts, by_part, probe
from loomdoc.llm.common import release_memory, remainder
from loomdoc.llm.hashing import WordHashes, lowered_words, mix, seeded
from loomdoc.session import dropped, written

#: Most bits of a filter that is broadcast (128 MB, once in every worker); a larger one is joined.
MODEL_BITS = 1 << 30
#: Most words whose exact counts are sent to every worker (16 bytes each).
HEAD = 200_000
#: Keys that a counting task holds before it passes them on.
PENDING = 3_000_000
#: Bytes of text whose n-grams are joined with the filter at once.
CHUNK_BYTES = 4 << 20
#: Ids with remainder 0 by FOLDS are held out.
FOLDS = 10
#: Levels of the word before, parts of an octave, places of the ratios' range, and the place of ratio 1.
LEVELS, FINE, BINS, OFFSET = 65, 8, 960, 320
END = b" end "  # no word holds a space
_TOP = np.uint64(0x7FFFFFFFFFFFFFFE)
_ONE = np.uint64(1)


def word_keys(h: np.ndarray) -> np.ndarray:
    """Keys of words: even, 63 bits."""
    return (mix(h) & _TOP).view(np.int64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of pairs of words: odd, 63 bits."""
    return ((mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b ^ seeded(5))) & _TOP) | _ONE).view(np.int64)


def token_hashes(texts: list, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, ends included, and the place after each text's end."""
    lists = [lowered_words(t) for t in texts]
    flat: list[bytes] = []
    for w in lists:
        flat += w
        flat.append(END)
    return hashes.array(flat), np.cumsum([len(w) + 1 for w in lists], dtype=np.int64)


def firsts(ends: np.ndarray, n: int) -> np.ndarray:
    """Marks the first token of every text."""
    mark = np.zeros(n, bool)
    if len(ends):
        mark[np.concatenate([[0], ends[:-1]])] = True
    return mark


def ngram_keys(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words and of all pairs inside a text."""
    inside = ~firsts(ends, len(h))[1:]
    return word_keys(h), pair_keys(h[:-1][inside], h[1:][inside])


def count_ngrams(texts: DataFrame, pending: int = PENDING) -> DataFrame:
    """key, n of every word and pair in a frame of one binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int32))], names=["key", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                h, ends = token_hashes(batch.column(0).slice(at, 500).to_pylist(), hashes)
                held += ngram_keys(h, ends)
                size += sum(map(len, held[-2:]))
                if size >= pending:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    return texts.mapInArrow(run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))


def level_of(n):
    return (F.floor(F.log2(n)) + 1).cast("int")


class Known:
    """Levels that have been read from a stored filter, of sorted keys."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        self.keys, self.found = keys, levels

    def levels(self, keys: np.ndarray, most: int = 64) -> np.ndarray:
        return self.found[np.searchsorted(self.keys, keys)]


def codes_of(p: np.ndarray, q: np.ndarray, before: np.ndarray) -> np.ndarray:
    """level * BINS + bin of every token: bin 0 for r = 0, else FINE * log2 r, rounded, but no more than p r = 1 allows."""
    exact = FINE * np.log2(np.maximum(q, 1e-30) / p)
    bins = np.minimum(np.rint(exact), np.floor(-FINE * np.log2(p)))
    return (np.minimum(before, LEVELS - 1) * BINS + np.where(q > 0, np.clip(bins + OFFSET, 1, BINS - 1), 0)).astype(np.uint16)


def ratio_of(code: np.ndarray) -> np.ndarray:
    return np.where(code % BINS == 0, 0.0, 2.0 ** ((code % BINS - OFFSET) / FINE))


class Model:
    """The filter with its level tables, as the workers use it, and the mixing weights once they are known.

    A filter beyond the broadcast bound is `stored`, a table of its parts that the
    driver alone holds; workers then get the levels of a chunk's n-grams in its place.
    """

    def __init__(self, bits: np.ndarray | None, segment_bits: int, means: dict[str, list[float]], n: int, v: int):
        self.filter = None if bits is None else Filter(bits, segment_bits)
        self.stored: DataFrame | None = None
        self.trained: tuple[DataFrame, str, str] | None = None
        self.segments, self.segment_bits = 0, segment_bits
        self.n, self.v = n, v
        self.means = {k: np.array(m) for k, m in means.items()}
        self.mixing: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"stored": None, "trained": None}

    def reading(self, known: Known) -> Model:
        """The model with the levels of a chunk's n-grams as its filter."""
        m = copy.copy(self)
        m.filter = known
        return m

    def count(self, keys: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Estimated counts and levels (0: not held)."""
        unique, back = np.unique(keys, return_inverse=True)
        levels = np.minimum(self.filter.levels(unique, 64), LEVELS)
        return self.means[kind][levels][back], levels[back]

    def parts(self, h: np.ndarray, first: np.ndarray, each: Callable[[np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the word's probability, and code, of every token (of a text's first word: that of no pair); each(p, q, level) gets those with every occurrence left out."""
        c, level = self.count(word_keys(h), "word")
        inner = np.flatnonzero(~first)
        pair, _ = self.count(pair_keys(h[inner - 1], h[inner]), "pair")
        before = np.zeros(len(h), np.int64)
        before[inner] = level[inner - 1]

        def chances(out: float) -> tuple[np.ndarray, np.ndarray]:
            left = np.maximum(c - out, 0)
            p = np.minimum(1.0, (left + 0.1) / (self.n + 0.1 * (self.v + 1))) if self.n else np.ones(len(h))
            q = np.zeros(len(h))
            q[inner] = np.minimum(1.0, np.maximum(pair - out, 0) / np.maximum(1.0, left[inner - 1]))
            return p, q

        if each:
            each(*chances(1.0), before)
        p, q = chances(0.0)
        return np.log10(p), codes_of(p, q, before)


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, held_out and the text t, never null, of every row."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (remainder(id_col, FOLDS) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))


def packed(rows: DataFrame) -> DataFrame:
    """chunk, payload: the rows in chunks of about CHUNK_BYTES of their texts `t`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def sealed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "payload"])

        for batch in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(batch.column("t")).to_pylist()):
                size += n + 16
                if size >= CHUNK_BYTES:
                    held.append(batch.slice(start, i + 1 - start))
                    yield sealed()
                    chunk, size, start = chunk + 1, 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield sealed()

    return rows.mapInArrow(run, "chunk long, payload binary")


def unpacked(payload: bytes, hashes: WordHashes) -> tuple[list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], np.ndarray]:
    """A chunk's rows by 200 with their token hashes and ends, and the sorted keys of all their n-grams."""
    table = pa.ipc.open_stream(payload).read_all()
    parts = [(b, *token_hashes(b.column("t").to_pylist(), hashes)) for b in table.to_batches(max_chunksize=200)]
    return parts, np.unique(np.concatenate([k for _, h, ends in parts for k in ngram_keys(h, ends)]))


def let_go(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that have ended, which else stay until the driver happens to collect its garbage."""
    for _ in range(2):  # the first round frees Python's handles
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def probed(rows: DataFrame, model: Model) -> DataFrame:
    """payload, found: chunks of rows, and by part the levels of their n-grams in the stored filter."""
    segments = model.segments

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, keys = unpacked(payload.as_py(), hashes)
                parts, asked = zip(*((part, keys[at].tobytes()) for part, at in by_part(keys, segments)))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array(asked, pa.binary())], names=["part", "chunk", "keys"])
            release_memory()

    chunks = written(packed(rows), "chunks")
    answers = probe(chunks.mapInArrow(ask, "part int, chunk long, keys binary"), model.stored, segments, model.segment_bits)
    found = written(answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "levels")).alias("found")), "levels")
    return chunks.join(found, "chunk").select("payload", "found")


def over(rows: DataFrame, model: Model, step: Callable[[Model, pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], model_of: Callable[[], Model], schema: str) -> DataFrame:
    """step on every 200 rows and their tokens, with a model that knows their n-grams: the broadcast one, or one of the levels found for their chunk."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = WordHashes(), model_of()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield step(m, part, *token_hashes(part.column("t").to_pylist(), hashes))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = WordHashes(), model_of()
        for batch in batches:
            for payload, found in zip(batch.column(0), batch.column(1)):
                parts, keys = unpacked(payload.as_py(), hashes)
                by = {x["part"]: np.frombuffer(x["levels"], np.uint8) for x in found.as_py()}
                levels = np.zeros(len(keys), np.int64)
                for part, at in by_part(keys, m.segments):
                    levels[at] = by[part]
                known = m.reading(Known(keys, levels))
                for part in parts:
                    yield step(known, *part)
            release_memory()

    return rows.mapInArrow(sent, schema) if model.stored is None else probed(rows, model).mapInArrow(joined, schema)


def mixing_weights(rows: list[tuple[int, int]]) -> np.ndarray:
    """For each level the weight w that maximises sum n log(w r + 1 - w) over (code, n), by EM."""
    out = np.zeros(LEVELS)
    codes, counts = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 2
    for level in np.unique(codes // BINS):
        own = codes // BINS == level
        r, n = ratio_of(codes[own]), counts[own].astype(float)
        w = 0.3
        for _ in range(200):
            w = float((n * (w * r / (w * r + 1 - w))).sum() / n.sum())
        out[level] = min(max(w, 1e-4), 0.95)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_bits: int = MODEL_BITS) -> tuple[Model, DataFrame]:
    """The model, and the exact counts of all training words (key, n). The mixing weights follow with the first texts that are scored."""
    train = text_rows(docs, id_col, text_col).where("NOT held_out")
    odd = F.col("key") % 2 != 0
    counted = written(count_ngrams(train.select("t")), "ngrams")
    shape = counted.groupBy(odd.alias("pair"), level_of(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).collect()  # at most 64 levels of two kinds
    n, v = (sum(r[k] for r in shape if not r.pair) for k in ("n", "c"))
    bits = sum(r.c * (K_FIRST + K_NEXT * (r.level - 1)) for r in shape) / math.log(2)
    segments = max(1, math.ceil(bits / SEGMENT_BITS))
    means = {"word": [0.0] * (LEVELS + 1), "pair": [0.0] * (LEVELS + 1)}
    for r in shape:
        means["pair" if r.pair else "word"][r.level] = r.n / r.c
    leveled = counted.select("key", level_of(F.col("n")).alias("level"))
    fits = segments * SEGMENT_BITS <= model_bits
    model = Model(build(leveled, segments) if fits else None, SEGMENT_BITS, means, n, v)
    spark = docs.sparkSession
    let_go(spark)
    if not fits:
        model.stored, model.segments = written(build_parts(leveled, segments), "filter"), segments
        let_go(spark)
    words = written(counted.where(~odd), "words")
    dropped(counted)
    model.trained = (docs, id_col, text_col)
    return model, words


def probabilities(docs: DataFrame, model: Model, counts: DataFrame, head: int, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: row, doc_id, held_out, n_tokens, n_known, base, the sum of log10 p and the codes of every row, tail (keys of words beyond the head), and on one row of a batch the batch's codes with occurrences left out and their counts."""
    spark = docs.sparkSession
    total = model.n + 0.1 * (model.v + 1)
    is_head = level_of(F.col("n")) >= head_level(counts, head)
    top = counts.where(is_head).select("key", "n").toPandas()  # at most `head` rows
    order = np.argsort(top["key"].to_numpy(np.int64))
    keys, values = top["key"].to_numpy(np.int64)[order], top["n"].to_numpy(np.float64)[order]
    sent = spark.sparkContext.broadcast((model, keys, values))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(m: Model, part: pa.RecordBatch, h: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        _, keys, values = sent.value
        sizes = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(ends)), sizes)
        k = word_keys(h)
        place = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
        known = keys[place] == k if len(keys) else np.zeros(len(k), bool)
        each = np.zeros(len(k))
        each[known] = np.log10((values[place[known]] + 0.1) / total)
        sums = lambda w: np.bincount(owner, weights=w, minlength=len(ends))
        tails = np.split(k[~known], np.cumsum(sums(~known).astype(np.int64))[:-1])
        first = firsts(ends, len(h))
        trained = ~first & ~np.repeat(part.column("held_out").to_numpy(zero_copy_only=False), sizes)
        left_out: list[bytes | None] = [None] * len(ends)

        def count_codes(p: np.ndarray, q: np.ndarray, before: np.ndarray) -> None:
            codes, n = np.unique(codes_of(p[trained], q[trained], before[trained]), return_counts=True)
            if len(codes):
                left_out[0] = codes.astype(np.int64).tobytes() + n.astype(np.int64).tobytes()

        logs, codes = m.parts(h, first, count_codes)
        codes[first] = 0
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(2), pa.array(sizes), pa.array(sums(known).astype(np.int64)), pa.array(sums(each)), pa.array(sums(logs)), pa.array([c.tobytes() for c in np.split(codes, ends[:-1])], pa.binary()), pa.array([x.tolist() for x in tails], pa.list_(pa.int64())), pa.array(left_out, pa.binary())],
            names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "log_p", "codes", "tail", "left_out"],
        )

    schema = f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, log_p double, codes binary, tail array<long>, left_out binary"
    out = written(over(text_rows(docs, id_col, text_col), model, run, lambda: sent.value[0], schema), "probabilities", compression="zstd")
    let_go(spark)
    return out


def head_level(counts: DataFrame, head: int) -> int:
    """The least level whose words, with all of higher levels, are at most `head`."""
    least, held = LEVELS, 0
    for r in counts.groupBy(level_of(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("level")).collect():  # at most 64 levels
        held += r.c
        if held > head:
            break
        least = r.level
    return least


def weights_of(passed: DataFrame) -> np.ndarray:
    """The mixing weights by the left-out codes of all training rows of a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS * BINS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                codes, n = np.frombuffer(x.as_py(), np.int64).reshape(2, -1)
                counts[codes] += n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["code", "n"])

    rows = passed.where("left_out IS NOT NULL").select("left_out").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most LEVELS * BINS
    return mixing_weights([(r.code, r.n) for r in rows])


def score(docs: DataFrame, model: Model, counts: DataFrame, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    total = model.n + 0.1 * (model.v + 1)
    passed = probabilities(docs, model, counts, head, id_col, text_col)
    if model.mixing is None:
        same = model.trained is not None and docs is model.trained[0] and (id_col, text_col) == model.trained[1:]
        model.mixing = weights_of(passed if same or model.trained is None else probabilities(*model.trained[:1], model, counts, head, *model.trained[1:]))
    code = np.arange(LEVELS * BINS)
    w = model.mixing[code // BINS]
    table = np.log10(np.maximum(w * ratio_of(code) + 1 - w, 1e-300))
    table[0] = 0.0  # no word before, or one never seen
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [float(sent.value[np.frombuffer(c.as_py(), np.uint16)].sum()) for c in batch.column("codes")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(batch.column("log_p").to_numpy() + np.array(more))], names=[*batch.schema.names[:6], "score"])

    rows = passed.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "log_p", "codes").mapInArrow(mixed, f"row long, doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double")
    tails = passed.select("row", F.explode("tail").alias("key"))
    c = F.coalesce(F.col("n"), F.lit(0))
    found = tails.join(counts.where(level_of(F.col("n")) < head_level(counts, head)), "key", "left").groupBy("row").agg(F.sum(F.log10((c + 0.1) / F.lit(total))).alias("more"), F.count("n").alias("more_known"))
    out = rows.join(found, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
