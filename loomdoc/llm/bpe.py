"""BPE encoding and decoding, exact for texts of any length.

A text is cut where the tokenizer's own pattern cuts it. A stretch that the
pattern leaves whole and that is longer than `leaf` characters is encoded by
tree concatenation: halves down to leaves, all leaves in one parallel batch,
then join by join upward. At a join a window of tokens on both sides is encoded
anew, and grows until its first token is the left side's and its last token the
right side's. A sequence of BPE tokens is the encoding of its bytes exactly when
each adjacent pair is the encoding of its own bytes, so such a window settles
the whole join.

Nulls encode as the empty text: no ids, the hash of nothing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import map_rows

#: Characters up to which an unsplit stretch goes to the library's merge loop as it is.
LEAF = 512
#: Leaves of one stretch that are encoded at a time.
THREADS = 2
#: Tokens on each side of a join that are encoded anew at first.
WINDOW = 4


class Bpe:
    """A byte-level BPE with its special tokens, from a public vocabulary."""

    def __init__(self, ranks_path: str, specials: dict[str, int], pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.codec = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
        self.specials = set(specials)
        self.has_special = [s for s in specials]
        self.leaf = leaf
        self.long = regex.compile(r"\S{%d,}|\s{%d,}" % (leaf, leaf))
        self.pieces = regex.compile(pattern)
        size = max([*ranks.values(), *specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in specials.items():
            self.bytes_of[i] = token.encode()
        self.digits = [str(i) for i in range(size)]

    def one(self, piece: str | bytes) -> list[int]:
        """The library's merges on one stretch, without its pattern."""
        return self.codec._encode_single_piece(piece) if piece else []

    @cached_property
    def pool(self) -> ThreadPoolExecutor:
        return ThreadPoolExecutor(THREADS)

    def encode(self, text: str) -> list[int]:
        if not self.long.search(text):
            return self.codec.encode(text, allowed_special=self.specials, disallowed_special=()) if any(s in text for s in self.has_special) else self.codec.encode_ordinary(text)
        ids: list[int] = []
        for k, part in enumerate(regex.split("(" + "|".join(map(regex.escape, self.has_special)) + ")", text) if self.has_special else [text]):
            if k % 2:
                ids += self.codec.encode(part, allowed_special="all")
            else:
                for piece in self.pieces.findall(part):
                    ids += self.whole(piece) if len(piece) > self.leaf else self.one(piece)
        return ids

    def whole(self, piece: str) -> list[int]:
        """Tree concatenation of one stretch that the pattern leaves whole."""
        parts, n = [piece], 1
        while len(piece) / n > self.leaf:
            parts = [half for p in parts for half in (p[: len(p) // 2], p[len(p) // 2 :])]
            n *= 2
        level = list(self.pool.map(self.one, parts))
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = WINDOW
        while left and right:
            a, b = left[-width:], right[:width]
            new = self.one(b"".join(self.bytes_of[i] for i in [*a, *b]))
            left_agrees = new[0] == a[0] or len(a) == len(left)
            right_agrees = new[-1] == b[-1] or len(b) == len(right)
            if left_agrees and right_agrees:
                return left[: -len(a)] + new + right[len(b) :]
            width *= 2
        return left + right

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


def public_bpe() -> Bpe:
    """The public 50k byte-level vocabulary, its pattern and its one special token."""
    import public_tokenizers as public

    return Bpe(public.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}, public.PATTERN)


def encode(docs: DataFrame, vocabulary: Callable[[], Bpe] = public_bpe, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids (if asked), decoded text's and ids' hashes.

    One row out for each row in; null texts count as empty. No shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def start():
        bpe = vocabulary()

        def step(columns: list[list]) -> Iterator[tuple]:
            for doc_id, text in zip(*columns):
                ids = bpe.encode(text or "")
                hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (bpe.joined(ids), bpe.decode(ids))]
                yield (doc_id, len(ids), *hashes, *([np.array(ids, np.int32)] if with_ids else []))  # a tenth of a list's memory

        return step

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), schema, start, block=500)
