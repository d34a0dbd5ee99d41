"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own
(offset + k * skip, from two hashes of its name). Shards take turns claiming
their next free slot, in name order, until the table is full, so slots differ by
at most one between shards, and a shard's leaving moves little but its own. A
key goes to the slot of its hash, in constant time, from a table of `size` rows
that is broadcast. Null keys hash as the empty string; equal keys share a shard;
an empty table gives no rows; no names is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime, and the broadcast table's row count.
SIZE = 65_537
#: Shards of the registered query.
SHARDS = tuple(f"shard-{k:03d}" for k in range(100))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def fill(names: tuple[str, ...], size: int = SIZE) -> list[int]:
    """The shard index of every slot."""
    if not names or len(names) > size or len(set(names)) < len(names):
        raise ValueError("names must be distinct, at least one, and no more than the slots")
    if size < 2 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    order = sorted(range(len(names)), key=names.__getitem__)
    at = {k: _number(f"offset {names[k]}") % size for k in order}
    skip = {k: _number(f"skip {names[k]}") % (size - 1) + 1 for k in order}
    table, free = [-1] * size, size
    while free:
        for k in order:
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]], free = k, free - 1
            if not free:
                break
    return table


def slot(key: Column, size: int = SIZE) -> Column:
    """The slot of a key: 32 bits of its text's md5, modulo the size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(docs: DataFrame, names: tuple[str, ...] = SHARDS, size: int = SIZE, id_col: str = "doc_id") -> DataFrame:
    """doc_id, slot and shard of every row; no shuffle."""
    table = docs.sparkSession.createDataFrame([(s, names[k]) for s, k in enumerate(fill(names, size))], "slot int, shard string")
    return docs.select(F.col(id_col).alias("doc_id"), slot(F.col(id_col), size).alias("slot")).join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")
