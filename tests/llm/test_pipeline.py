"""The pipeline and its stages against a plain version in Python, with nulls, repeated ids, clashing columns and empty tables."""

import collections
import hashlib
import random

import corpus_pipeline as P
from loomdoc.llm import toxicity
from tests.llm.test_operators import brute, hf

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, score string, n_lines long, kept boolean, items string"


def corpus():
    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"i{k}", say(14)) for k in range(5)]
    docs = []
    for i in range(140):
        body = say(rng.randrange(20, 70))
        if i % 7 == 0:
            body += f" vile{i % 3} filth{i % 2} scum"
        if i % 11 == 3:
            body += " " + items[i % 5][1]
        if i % 9 == 4:  # a near copy of the one before, or an exact one
            body = docs[-1][1].split("\n")[-1] if i % 2 else docs[-1][1].split("\n")[-1] + " more"
        docs.append((i, f"menu of the site\n{body}" if i % 4 else body, "en", f"s{i % 2}"))
    docs += [(500, None, None, None), (501, "", "en", "s0"), (None, say(30), "en", "s1"), (502, " \n ", "en", None), (503, "long " * 20_000, "en", "s0"), (504, say(30), "en", "s0")]
    docs += [docs[-1], (505, say(30), "en", "s1"), (505, say(30), "en", "s1")]
    rows = [(*d, k, f"s{k}", k, k % 2 == 0, "x") for k, d in enumerate(docs)]
    return rows, [(d[0], 0, int("scum" in (d[1] or ""))) for d in docs if d[0] is not None], items


def write(spark, path, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")


def plain(rows, model, items):
    """Stage by stage, row by row; all rows keep their columns."""
    out = {}
    rows = [r for r in rows if model.score(model.normalised([model.weigh(t) for t in r[1].lower().split()]) if r[1] else []) < 0.5]
    out["toxicity"] = rows
    hosts = collections.Counter(r[3] for r in rows)
    lines = collections.Counter((r[3], x) for r in rows if r[1] is not None for x in {x.strip(" ") for x in r[1].split("\n")} if x)
    bad = {k for k, n in lines.items() if n >= 5 and n > 0.02 * hosts[k[0]]}
    rows = [(r[0], r[1] and "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(" ")) not in bad), *r[2:]) for r in rows]
    out["line_dedup"] = rows
    label = {}
    named = [(k, r[1] or "") for k, r in enumerate(rows)]
    same = brute(named, 5, 80)
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[same[k]].append(r[0])
    first = {k: min((i for i in groups[same[k]] if i is not None), default=None) for k in range(len(rows))}
    gone = {r[0] for k, r in enumerate(rows) if r[0] is not None and r[0] != first[k] and len((r[1] or "").split())}
    seen = set()
    kept = []
    for r in rows:
        if r[0] is None or r[0] not in gone and (r[0], r[1]) not in seen:
            kept.append(r)
            seen.add((r[0], r[1]))
    rows = out["near_dedup"] = kept
    grams = {tuple(t.split()[k : k + 10]) for _, t in items for k in range(len(t.split()) - 9)}
    holds = lambda t: any(tuple(w[k : k + 10]) in grams for w in [t.lower().split()] for k in range(len(w)))
    rows = out["decontamination"] = [r for r in rows if not holds(r[1] or "")]
    out["bpe"] = rows
    return out


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def test_stages_and_run_equal_a_plain_version(spark, tmp_path):
    rows, labels, items = corpus()
    sf = f"file://{tmp_path}/sf"
    write(spark, sf, rows, labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = plain(rows, model, items)
    assert 0 < len(want["bpe"]) < len(want["near_dedup"]) < len(want["line_dedup"]) < len(rows)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = P.written(out, "test")
        got = [tuple(r) for r in docs.collect()]
        if name == "near_dedup":  # of rows equal in id and text any one stays
            cut = lambda rs: sorted((key(r[:4]) for r in rs))
            assert cut(got) == cut(want[name])
        else:
            assert name == "decontamination" or sorted(map(key, got)) == sorted(map(key, want[name])), name
    codec = hf()
    tokens = {(r[0], tuple(codec.encode(r[1] or "", add_special_tokens=False).ids)) for r in want["bpe"]}
    got = P.run(spark, sf).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in got} == tokens and len(got) == len(want["bpe"])
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)


def test_empty_tables(spark, tmp_path):
    _, labels, items = corpus()
    sf = f"file://{tmp_path}/none"
    write(spark, sf, [], labels[:0], items[:0])
    assert P.run(spark, sf).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0


def test_sets_are_made_in_a_stage_of_their_own(spark):
    """However few the candidates, no stage holds two Python operators, whose workers would stay beside those of later stages."""
    from loomdoc.llm import near_dup

    docs = spark.createDataFrame([(i, bytearray(b"a b c d e f")) for i in range(9)], "doc_id long, t binary")
    clusters = spark.createDataFrame([(i, 0) for i in range(4)], "node long, component long")
    found = near_dup._candidates(docs, clusters)
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2, 3]
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [doc_id" in final, final


def test_long_rows_come_in_small_parts(spark):
    """A part of a batch holds few rows where they are long, and all rows come once."""
    from loomdoc.llm.common import PART_BYTES, map_rows

    def start():
        def step(columns):
            held = sum(map(len, columns[1]))
            for i, t in zip(*columns):
                yield i, held

        return step

    docs = spark.range(40, numPartitions=1).selectExpr("id", "repeat('x', 200000) AS t")
    got = map_rows(docs, "id long, held long", start).collect()
    assert sorted(r.id for r in got) == list(range(40)) and max(r.held for r in got) <= 2 * PART_BYTES
