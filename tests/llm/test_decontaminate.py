"""The positional index, phrases and ordered proximity against brute force, and odd rows."""

import itertools
import random

import numpy as np

from loomdoc.llm import decontaminate as D
from loomdoc.llm.hashing import WordHashes


def slow_near(words, window, slack):
    """By definition: places in order, one for each word, with at most slack others among them."""
    places = [[p for p, w in enumerate(words) if w == x] for x in window]
    return any(list(c) == sorted(set(c)) and c[-1] - c[0] < len(window) + slack for c in itertools.product(*places))


def test_ordered_proximity_equals_brute_force(spark):
    rng = random.Random(12)
    vocab = "abcdefg"
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 6])))) for i in range(25)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slack, size in ((1, 200), (3, D.BLOCK_CHARS)):
        got = {r.doc_id: r for r in D.decontaminate(d, b, window=4, slack=slack, block_chars=size).collect()}
        for i, t in docs:
            w = t.split()
            wins = {k: [x.split()[j : j + 4] for j in range(max(1, len(x.split()) - 3))] for k, x in items}
            assert got[i].near_items == sorted(str(k) for k, v in wins.items() if any(slow_near(w, x, slack) for x in v))
            assert got[i]["items"] == sorted(str(k) for k, v in wins.items() if any(slow_near(w, x, 0) for x in v))
            assert got[i].n_hit == len({s.first + j for s in got[i].spans for j in range(s.length)}) and got[i].n_words == len(w)


def test_postings_round_trip_over_many_documents():
    rng = random.Random(3)
    hashes = WordHashes()
    docs = [hashes.array([rng.choice("abcdefgh").encode() for _ in range(rng.choice([0, 1, 5, 400]))]) for _ in range(30)]
    bases = np.cumsum([0, *(len(h) + 1 for h in docs[:-1])])
    shard = D.Shard([{"base": int(b)} for b in bases], *D.packed(*D.postings(docs)))
    want = sorted((int(np.searchsorted(shard.terms, h)), int(b) + k) for b, d in zip(bases, docs) for k, h in enumerate(d))
    assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in shard.keys] == want
    empty = D.Shard([], *D.packed(*D.postings([])))
    assert list(D.found_in(empty, D.block_of([("1", b"a b")]), 2)) == []


def test_long_texts_are_tokenised_piece_by_piece(monkeypatch):
    text = " ".join(f"Wörter{k}, x" for k in range(3_000)).encode()
    whole = D.token_hashes(text, WordHashes())
    monkeypatch.setattr(D, "PIECE_BYTES", 100)
    assert (D.token_hashes(text, WordHashes()) == whole).all() and len(whole) == 6_000


def test_odd_rows(spark):
    docs = [(None, "A b C"), (1, None), (2, ""), (3, "--- \n"), (4, "a B, c d"), (4, "a B, c d"), (5, "x " * 200_000 + "a b c"), (6, "c b a")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words int, items string")
    b = spark.createDataFrame([("i", "a b c"), ("i", "a b c"), ("j", "zz"), ("n", None), (None, "a b c"), ("e", " ")], "item_id string, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in D.decontaminate(d, b).collect()))
    assert got == [(0, 3, 3, ("i",)), (1, 0, 0, ()), (2, 0, 0, ()), (3, 0, 0, ()), (4, 4, 3, ("i",)), (4, 4, 3, ("i",)), (5, 200_003, 3, ("i",)), (6, 3, 0, ())]
    assert D.decontaminate(d.limit(0), b).count() == 0
    assert [r.n_hit for r in D.decontaminate(d, b.limit(0)).collect()] == [0] * 8
