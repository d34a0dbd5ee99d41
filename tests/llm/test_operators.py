"""The operators on small fixtures: brute force, round trips and odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from loomdoc.llm import bpe, components, decontaminate, licences, line_dedup, lm, near_dup, quality, sharding, toxicity

ODD = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "x", "a"), (5, "x", "a"), (5, "x", "a"), (6, "word " * 30_000, "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in ODD], "doc_id long, text string, source string, score string, kept double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


RUNS = {
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "licences": lambda s, d: licences.scan(d),
    "sharding": lambda s, d: sharding.place(d),
    "near": lambda s, d: near_dup.near_duplicates(d, 2),
    "quality": lambda s, d: quality.judge(d),
    "lm": lambda s, d: lm.score(d, *lm.fit(d)),
    "bpe": lambda s, d: bpe.encode(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s, [(4, 1), (6, 0), (6, None)]))),
    "decontamination": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "x"), (2, None), (3, "")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(spark, odd, none, name):
    assert RUNS[name](spark, odd).count() == len(ODD)
    assert RUNS[name](spark, none).count() == 0


def test_odd_rows_near(spark, odd):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd, 2).collect())
    assert [(n, c, k) for _, n, c, k in got] == [(0, 1, True), (0, 2, True), (0, 3, True), (1, 4, True), (1, 4, False), (1, 4, False), (1, 6, True), (0, None, True)]


def brute(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for g in range(6):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 60))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k in (2, 5):
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, k).collect()} == brute(docs, k, 80)


def test_large_clusters_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{n}" for n in range(80)]
    docs = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = f"v{i}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(f"x{i}-{n}" for n in range(20))) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 2).collect()} == brute(docs, 2, 80)
    texts = df.selectExpr("doc_id", "cast(text AS binary) AS t")
    clusters = df.where("doc_id < 60").selectExpr("doc_id AS node", "0L AS component")
    parts = [r["count"] for r in near_dup._candidates(texts, clusters).where("cluster = 0").groupBy("part").count().collect()]
    assert sum(parts) == 60 and len(parts) > 1 and max(parts) < 30


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:250], rng.integers(0, 2**63, 50).astype(np.uint64)])
    s = near_dup.sketches([a, b, a[:1]], 240)
    assert abs((s[0] == s[1]).mean() - 250 / 350) < 0.12
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_components(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}


def test_components_with_hubs(spark):
    rng = random.Random(5)
    links = [(1000, n) for n in range(1001, 1200)] + [(n, 5000) for n in range(1300, 1500)] + [(1100, 1400)]
    links += [(a, a + 1) for a in range(2000, 2040)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    links += [(a, 3000) for a in range(3001, 3005)]
    top = {n: n for p in links for n in p if p[0] != p[1]}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            top[high] = low
    e = spark.createDataFrame(links, "a long, b long")
    assert sorted(tuple(r) for r in components.components(e).collect()) == sorted((n, find(n)) for n in top)


def hf():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library_and_round_trips():
    rng = random.Random(5)
    t = hf()
    b = bpe.Bpe(**{"ranks_path": __import__("public_tokenizers").path("byte_bpe_50k.tiktoken"), "specials": {"<|endoftext|>": 50256}, "pattern": __import__("public_tokenizers").PATTERN, "leaf": 16})
    pools = ["ab", "abcdefghijklmnopqrstuvwxyz", " \n\t", "0123456789", "!?.,'-", "éüßñ漢字🙂", "the ing ion "]
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b", "a" * 3000, " " * 3000, "é" * 999, "don't 'll", "x" * 700 + " " + "y" * 700]
    for _ in range(150):
        texts.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 200))))
        texts.append("".join(rng.choice(rng.choice(pools[:2])) for _ in range(rng.randrange(20, 900))))
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert b.encode(x) == ids, repr(x[:80])
        assert b.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark):
    r = bpe.encode(spark.createDataFrame([(1, None), (2, "hello world")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].n_tokens, r[0].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert r[1].ids == hf().encode("hello world").ids and r[1].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()


def test_segments_equal_brute_force():
    def slow(x):  # recursive definition: the best run, then the parts beside it
        if not any(v > 0 for v in x):
            return []
        best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)))
        s, _, _, a, b = best
        return [(i, j, v) for i, j, v in slow(x[:a])] + [(a, b, s)] + [(i + b, j + b, v) for i, j, v in slow(x[b:])]

    rng = random.Random(2)
    for _ in range(300):
        x = [rng.choice([-3.0, -2.03, -1.07, 1.01, 2.11, 3.5]) + rng.random() / 64 for _ in range(rng.randrange(0, 14))]
        a, b = toxicity.segments(x), slow(x)
        assert [(i, j) for i, j, _ in a] == [(i, j) for i, j, _ in b]
        assert np.allclose([v for *_, v in a], [v for *_, v in b])


def test_toxicity_learns(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        w = [f"w{rng.randrange(200)}" for _ in range(40)]
        if i % 5 == 0:
            w[rng.randrange(40)] = f"vile{rng.choice('abcdef')}"
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, labels(spark, [(r[0], r[2]) for r in rows]))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == y for i, _, y in rows if got[i].held_out)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)


def test_decontamination_blocks_and_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"t{i}" for i in range(8)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 10, 12])))) for i in range(12)]
    docs = [(i, ". ".join(rng.choice(vocab).upper() for _ in range(rng.randrange(0, 60))) + (" " + items[i % 12][1] if i % 2 else "")) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    win = collections.defaultdict(set)
    for i, t in items:
        w = t.split()
        for k in range(max(1, len(w) - 9)):
            win[tuple(w[k : k + 10])].add(str(i))
    want = {}
    for i, t in docs:
        w = t.lower().replace(".", "").split()
        hit, found = set(), set()
        for g, who in win.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= who
        want[i] = (len(w), len(hit), sorted(found))
    for size in (decontaminate.BLOCK_CHARS, 200):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(d, b, block_chars=size).collect()}
        assert got == want
    near = decontaminate.decontaminate(spark.createDataFrame([(1, "a b X c d e")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"), slack=1).head()
    assert near["items"] == [] and near.near_items == ["1"]


def test_lm_counts_and_filter(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"W{int(rng.paretovariate(0.7))}" for _ in range(50))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = collections.Counter()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    for i, t in docs:
        if not held[i]:
            counts.update([*t.lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    model, kept = lm.fit(df)
    assert (model.n, model.v) == (n, v)
    for head in (0, 5, 10_000):
        for r in lm.score(df, model, kept, head).collect():
            w = [*docs[r.doc_id][1].lower().split(), None]
            assert (r.n_tokens, r.train_tokens, r.held_out) == (len(w), n, held[r.doc_id])
            assert r.n_known == sum(counts[x] > 0 for x in w)
            assert abs(r.base_score - sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6
            assert r.score < 0
    h = lm.WordHashes()
    for w in list(counts)[:50]:
        key = lm.word_keys(h.array([(w or lm.END.decode()).encode()]))
        assert model.filter.levels(key)[0] >= int(math.log2(counts[w])) + 1


def test_lm_knows_pairs_of_count_one(spark):
    docs = [(i, f"only{i} once{i}") for i in range(40)]
    model, _ = lm.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    h = lm.WordHashes()
    for i, t in docs:
        a, b = (h.array([w.encode()]) for w in t.split())
        n, level = model.count(lm.pair_keys(a, b), "pair")
        if zlib.crc32(str(i).encode()) % 10:
            assert (n[0], level[0]) == (1, 1)


def slow_scores(docs):
    """The model's definition with exact counts: level means, eighths of octaves, weights by EM over left-out occurrences."""
    split = {i: [*(t or "").lower().split(), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in split}
    words, pairs = collections.Counter(), collections.Counter()
    for i, w in split.items():
        if not held[i]:
            words.update(w)
            pairs.update(zip(w, w[1:]))
    level = lambda n: int(math.floor(math.log2(n))) + 1 if n else 0
    mean = {}
    for kind, counts in (("word", words), ("pair", pairs)):
        by = collections.defaultdict(list)
        for n in counts.values():
            by[level(n)].append(n)
        mean[kind] = {0: 0.0} | {k: sum(v) / len(v) for k, v in by.items()}
    n, v = sum(words.values()), len(words)

    def token(a, b, out):
        c = lambda x: max(mean["word"][level(words[x])] - out, 0)
        p = min(1.0, (c(b) + 0.1) / (n + 0.1 * (v + 1)))
        q = min(1.0, max(mean["pair"][level(pairs[a, b])] - out, 0) / max(1.0, c(a)))
        r = 2 ** (min(round(8 * math.log2(q / p)), math.floor(-8 * math.log2(p))) / 8) if q > 0 else 0.0
        return p, r

    seen = collections.defaultdict(collections.Counter)
    for i, w in split.items():
        if not held[i]:
            for a, b in zip(w, w[1:]):
                seen[level(words[a])][token(a, b, 1)[1]] += 1
    weight = collections.defaultdict(float)
    for lv, rs in seen.items():
        x = 0.3
        for _ in range(200):
            x = sum(k * x * r / (x * r + 1 - x) for r, k in rs.items()) / sum(rs.values())
        weight[lv] = min(max(x, 1e-4), 0.95)
    out = {}
    for i, w in split.items():
        total = math.log10(min(1.0, (mean["word"][level(words[w[0]])] + 0.1) / (n + 0.1 * (v + 1))))
        for a, b in zip(w, w[1:]):
            p, r = token(a, b, 0)
            x = weight[level(words[a])]
            total += math.log10(p * (x * r + 1 - x))
        out[i] = total
    return out


def test_lm_scores_equal_brute_force(spark):
    rng = random.Random(14)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60)))) for i in range(80)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(df, *lm.fit(df)).collect()}
    want = slow_scores(docs)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    # a model scores other texts by the weights of its own
    model, counts = lm.fit(df)
    few = df.where("doc_id < 7")
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in lm.score(few, model, counts).collect())


def test_lm_mixing_weights_come_from_all_training_rows(spark):
    # only the last of 1,201 documents has words of this level
    docs = [(i, f"a{i} b{i}") for i in range(1_200)] + [(1_205, "left right " * 3_000)]
    assert zlib.crc32(b"1205") % 10
    level = int(math.log2(3_000)) + 1
    # rows without an id are training rows, too
    for rows in (docs, [(None, t) for _, t in docs]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        model, counts = lm.fit(df)
        lm.score(df, model, counts)
        assert model.mixing[level] > 0.5


def test_lm_filter_beyond_the_broadcast_bound_is_joined(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(f"W{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(lm, "SEGMENT_BITS", 1 << 12)
    runs = []
    for bound in (lm.MODEL_BITS, 1):
        model, counts = lm.fit(df, model_bits=bound)
        assert (model.stored is None) == (bound > 1)
        scored = sorted(tuple(r) for r in lm.score(df, model, counts).collect())
        runs.append((model.mixing.tolist(), scored))
    assert runs[0] == runs[1] and len(runs[0][1]) == 80


def test_sharding_is_even_and_stable():
    names = tuple(f"s{i}" for i in range(7))
    t = sharding.fill(names, 997)
    sizes = collections.Counter(t)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill(names[:-1], 997)
    moved = sum(names[a] != names[b] for a, b in zip(t, fewer) if a != 6)
    assert moved < 997 * 0.25
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.fill(bad, 997)


def test_line_dedup_shuffled_join_equals_broadcast(spark):
    rows = [(i, "\n".join(["menu", f"own {i}", "", "menu"] if i % 2 else [f"own {i}"]), "a" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = ({tuple(r) for r in line_dedup.dedup_lines(df, 0.1, 3, broadcast_lines=n).collect()} for n in (10, 0))
    assert a == b and (1, "own 1\n", "a", 4, 2) in a and (0, "own 0", None, 1, 0) in a
