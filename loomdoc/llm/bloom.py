"""Segmented Bloom filters over (key, level), built in the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomdoc.llm.common import release_memory
from loomdoc.llm.hashing import mix, seeded

#: Bits of a segment; a segment is built in one task.
SEGMENT_BITS = 1 << 20
#: Hash functions of a key's first level and of each further one.
K_FIRST, K_NEXT = 8, 2
#: Segments that are stored and probed together (2 MB of bits).
PART_SEGMENTS = 16
#: Keys that a dealing task holds before it passes them on.
DEALT = 1_000_000
_ONE = np.uint64(1)


class Filter:
    """A segmented Bloom filter over (key, level), or the part of one that begins with segment `first` of `segments`."""

    def __init__(self, bits: np.ndarray, segment_bits: int = SEGMENT_BITS, segments: int | None = None, first: int = 0):
        self.bits, self.segment_bits, self.first = bits, segment_bits, first
        self.segments = segments or len(bits) * 8 // segment_bits

    @staticmethod
    def seeds(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and step of a level's bit places."""
        h = mix(keys.view(np.uint64) + seeded(1000 + level))
        return h, (h >> np.uint64(32)) | _ONE

    @staticmethod
    def place(h: np.ndarray, step: np.ndarray, row: int, segment_bits: int) -> np.ndarray:
        """Bit places inside the segment by the row-th hash function; segment_bits is a power of two up to 2^32."""
        return ((h + np.uint64(row) * step) & np.uint64(segment_bits - 1)).view(np.int64)

    def levels(self, keys: np.ndarray, most: int = 64) -> np.ndarray:
        """The highest level to which every level below is present."""
        out = np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        base = (segment_of(keys, self.segments) - self.first) * self.segment_bits
        for level in range(1, most + 1):
            if not len(at):
                break
            h, step = self.seeds(keys[at], level)
            for row in range(K_FIRST if level == 1 else K_NEXT):
                bit = base + self.place(h, step, row, self.segment_bits)
                held = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                if not held.all():
                    at, base, h, step = at[held], base[held], h[held], step[held]
            out[at] = level
        return out


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ seeded(77)) % np.uint64(max(1, segments))).astype(np.int64)


def by_part(keys: np.ndarray, segments: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that keys fall into, with the places of its keys in their order."""
    part = segment_of(keys, segments) // PART_SEGMENTS
    if segments <= PART_SEGMENTS << 15:
        part = part.astype(np.int16)  # sorted by radix
    order = np.argsort(part, kind="stable")
    dealt = part[order]
    starts = np.flatnonzero(np.diff(dealt, prepend=-1))
    return zip(dealt[starts].tolist(), np.split(order, starts[1:]) if len(starts) else [])


def build_parts(ngrams: DataFrame, segments: int, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """part, bits of every part with keys, each built in one task from its (key, level) rows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            keys, levels = (np.concatenate(x) for x in zip(*held))
            held.clear()
            rows = [(part, keys[at].tobytes(), levels[at].tobytes()) for part, at in by_part(keys, segments)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "keys", "levels"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)))
            if sum(len(k) for k, _ in held) >= DEALT:
                yield dealt()
        if held:
            yield dealt()

    def fill(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        first = part * PART_SEGMENTS
        bits = np.zeros(min(PART_SEGMENTS, segments - first) * segment_bits, bool)
        for k, lv in zip(table.column("keys"), table.column("levels")):
            keys, levels = np.frombuffer(k.as_py(), np.int64), np.frombuffer(lv.as_py(), np.uint8)
            base = (segment_of(keys, segments) - first) * segment_bits
            for level in range(1, int(levels.max(initial=0)) + 1):
                at = levels >= level
                h, step = Filter.seeds(keys[at], level)
                for row in range(K_FIRST if level == 1 else K_NEXT):
                    bits[base[at] + Filter.place(h, step, row, segment_bits)] = True
        return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return ngrams.select("key", "level").mapInArrow(deal, "part int, keys binary, levels binary").groupBy("part").applyInArrow(fill, "part int, bits binary")


def build(ngrams: DataFrame, segments: int, segment_bits: int = SEGMENT_BITS) -> np.ndarray:
    """The bits of all segments, for a filter small enough to be sent."""
    out = np.zeros(segments * segment_bits // 8, np.uint8)
    for r in build_parts(ngrams, segments, segment_bits).toLocalIterator():  # the caller bounds the segments
        at = r.part * PART_SEGMENTS * segment_bits // 8
        out[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def probe(asked: DataFrame, parts: DataFrame, segments: int, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """chunk, part, levels (a byte a key) of asked keys (part, chunk, keys): each part's keys meet its bits in one task, so the filter may have any size."""

    def answer(asks: pa.Table, stored: pa.Table) -> pa.Table:
        out = []
        if asks.num_rows:
            part = asks.column("part")[0].as_py()
            bits = np.frombuffer(stored.column("bits")[0].as_py(), np.uint8) if stored.num_rows else None
            held = None if bits is None else Filter(bits, segment_bits, segments, part * PART_SEGMENTS)
            for k in asks.column("keys"):
                keys = np.frombuffer(k.as_py(), np.int64)
                out.append((held.levels(keys) if held else np.zeros(len(keys))).astype(np.uint8).tobytes())
        release_memory()
        return pa.table({"chunk": asks.column("chunk"), "part": asks.column("part"), "levels": pa.array(out, pa.binary())})

    return asked.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(answer, "chunk long, part int, levels binary")
