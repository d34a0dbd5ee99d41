"""Toxicity by maximum-scoring segments of token log-odds.

Learning: over distinct labelled texts, log-odds with a Dirichlet prior of every
word and word beginning between toxic and other documents; those that are at
least Z standard errors from nought, on either side, make the model. A token scores its most
certain feature's log-odds, any other token -DRIFT. Scoring: one linear scan
finds all maximal-scoring segments of a text; lambda and K of the extreme-value
distribution of segment scores come from clean documents; the segments whose
normalised score is above nought are the toxic passages, and the sum of their
normalised scores, through a logistic curve fitted on the labelled sample, is the
document's score.

Rules: a null or wordless text scores as one without a toxic passage. Rows are
scored one by one, so repeated rows get equal scores. Labels that are null are
not used; of repeated labels of an id the largest holds. Without both kinds of
label every score is the share of toxic labels (0 without any). Equal segments
stand in order of place. Whole texts are scanned, in time linear in their words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import CARRIED, bounded_sample, map_rows, remainder

#: Most labelled documents that the model is fitted on.
LABELLED = 20_000
#: Weight of the Dirichlet prior, in documents.
PRIOR = 100.0
#: Least certainty of a feature.
Z = 3.0
#: What a token without a feature costs.
DRIFT = 0.25
#: Lengths of word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)
#: Ids with this remainder by FOLDS are held out.
FOLDS = 5
_STRIP = ".,;:!?\"'()[]{}<>*#%$&|-_…«»“”‘’¡¿"


def token_features(token: str) -> list[str]:
    """The word without outer marks, and its beginnings (with a trailing hyphen)."""
    w = token.strip(_STRIP)
    return [w, *(f"{w[:n]}-" for n in BEGINNINGS if len(w) > n)] if w else []


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, after the last, sum), by one linear scan.

    Each candidate keeps the running sum before and after it; a new positive
    score joins the candidates back to the nearest one with a smaller sum before
    it, if the sum after that one is smaller than the new one's.
    """
    done: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest earlier with a smaller sum before
    total = 0.0
    for at, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, low = at, before
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][2] >= low:
                j = done[j][4]
            if j < 0 or done[j][3] >= total:
                break
            first, low = done[j][0], done[j][2]
            del done[j:]
        done.append((first, at + 1, low, total, j))
    return [(a, b, after - low) for a, b, low, after, _ in done]


@dataclass
class Model:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature: log-odds, z
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    bias: float = 0.0
    share: float | None = None  # the score of all, if there is nothing to learn

    def weigh(self, token: str) -> float:
        found = [self.weights[f] for f in token_features(token) if f in self.weights]
        return max(found, key=lambda x: abs(x[1]))[0] if found else -DRIFT

    def normalised(self, scores: list[float]) -> list[tuple[int, int, float]]:
        """The significant segments with their normalised scores."""
        if not scores or max(scores) <= 0:
            return []
        level = math.log(max(1.0, self.k * len(scores)))
        return [(a, b, x) for a, b, s in segments(scores) if (x := self.lam * s - level) > 0]

    def score(self, found: list[tuple[int, int, float]]) -> float:
        if self.share is not None:
            return self.share
        x = sum(f[2] for f in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.bias))))


class Weigher(dict):
    """Token to score, remembered; emptied when it holds too many."""

    def __init__(self, model: Model, most: int = 300_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, token: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[token] = s = self.model.weigh(token)
        return s


def sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Distinct texts with labels, not held out, at most `most`, by a hash of the id; with their tokens' texts."""
    y = labels.where(F.col(label_col).isNotNull() & (remainder(id_col, FOLDS) > 0)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("y"))
    y = bounded_sample(y, ["label_id"], most)
    picked = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("sample_text")).join(F.broadcast(y), "label_id")  # at most `most` rows
    return picked.where("sample_text is not null").groupBy(F.xxhash64("sample_text").alias("h"), "sample_text").agg(F.max("y").alias("y")).select("sample_text", (F.col("y") > 0).alias("y"))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the labelled sample: counts in executors, a bounded table of features and scores in the driver."""
    from loomdoc.session import written

    texts = written(sample(docs, labels, most, id_col, text_col, label_col), "toxic-sample")
    sizes = {r.y: r.n for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Model(share=float(toxic > 0))
    both = toxic + clean

    def count():
        def step(columns: list[list]) -> Iterator[tuple]:
            counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for text, y in zip(*columns):
                counts[bool(y)].update({f for t in set(text.lower().split()) for f in token_features(t)})
            for f, n in counts[1].items():
                yield f, n, counts[0].pop(f, 0)
            yield from ((f, 0, n) for f, n in counts[0].items())

        return step

    n1, n0 = F.sum("n1"), F.sum("n0")
    counted = map_rows(texts, "feature string, n1 long, n0 long", count, block=5_000).groupBy("feature").agg(n1.alias("n1"), n0.alias("n0")).where("n1 + n0 >= 2")
    prior = F.col("n1") * (PRIOR / both) + F.col("n0") * (PRIOR / both)

    def odds(n: str, size: int):
        return F.log((F.col(n) + prior) / (F.greatest(F.lit(size) - F.col(n), F.lit(0)) + PRIOR - prior + 1e-9))

    scored = counted.select("feature", (odds("n1", toxic) - odds("n0", clean)).alias("w"), F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior)).alias("se")).withColumn("z", F.col("w") / F.col("se")).where((F.abs("z") >= Z) & (F.abs("w") > 0.5))
    model = Model({r.feature: (r.w, r.z) for r in scored.select("feature", "w", "z").collect()})
    if not model.weights:
        return Model(share=toxic / both)

    def measure():
        weigh = Weigher(model).__getitem__

        def step(columns: list[list]) -> Iterator[tuple]:
            for text, y in zip(*columns):
                scores = list(map(weigh, text.lower().split()))
                values = Counter(round(s, 2) for s in scores)
                yield bool(y), len(scores), [x[2] for x in segments(scores)] if scores and max(scores) > 0 else [], list(values), list(values.values())

        return step

    rows = map_rows(texts, "y boolean, n long, s array<double>, v array<double>, c array<long>", measure, block=2_000).collect()  # at most `most` rows of numbers
    model.lam, model.k = extreme_values([(r.n, max(r.s, default=0.0), dict(zip(r.v, r.c))) for r in rows if not r.y])
    points = []
    for r in rows:
        level = math.log(max(1.0, model.k * max(1, r.n)))
        points.append((sum(x for s in r.s if (x := model.lam * s - level) > 0), float(r.y)))
    model.slope, model.bias = logistic(points)
    return model


def extreme_values(clean: list[tuple[int, float, dict[float, int]]]) -> tuple[float, float]:
    """lambda: the root of sum p exp(lambda s) = 1 over clean tokens; K: from the clean documents' best segments."""
    values: Counter[float] = Counter()
    for _, _, c in clean:
        values.update(c)
    total = sum(values.values()) or 1
    lo, hi = 0.0, 1.0
    mean = lambda lam: sum(n / total * math.exp(min(700.0, lam * s)) for s, n in values.items())
    if any(s > 0 for s in values):
        while mean(hi) < 1 and hi < 8:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    lam = min(1.0, hi)
    # A Gumbel location by maximum likelihood; documents without a segment count at score 0.
    k = len(clean) / max(1e-9, sum(max(1, n) * math.exp(-lam * s) for n, s, _ in clean)) if clean else 1.0
    return lam, k


def logistic(points: list[tuple[float, float]], ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias by Newton's method; a small ridge keeps separable data finite."""
    a, b, n = 0.1, 0.0, len(points)
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            w = p * (1 - p)
            g1, g0 = g1 + (p - y) * x, g0 + (p - y)
            h11, h01, h00 = h11 + w * x * x, h01 + w * x, h00 + w
        g1, g0, h11, h00 = g1 + ridge * n * a, g0 + ridge * b, h11 + ridge * n, h00 + ridge
        det = h11 * h00 - h01 * h01
        if det < 1e-12:
            break
        da, db = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
        a, b = a - max(-2.0, min(2.0, da)), b - max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 1e-3), b


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and the toxic passages (first word, words, normalised score), with the carried columns named CARRIED before their names; no shuffle."""
    types = {c: docs.schema[c].dataType.simpleString() for c in (id_col, text_col, *carry)}
    schema = f"doc_id {types[id_col]}, held_out boolean, score double, predicted int, n_passages int" + ", passages array<struct<first:int,length:int,score:double>>" * with_spans + "".join(f", `{CARRIED}{c}` {types[c]}" for c in carry)

    def start():
        weigh = Weigher(model).__getitem__

        def step(columns: list[list]) -> Iterator[tuple]:
            for doc_id, text, held_out, *rest in zip(*columns):
                found = model.normalised(list(map(weigh, text.lower().split()))) if text else []
                s = model.score(found)
                yield doc_id, held_out, s, int(s >= 0.5), len(found), *([[{"first": a, "length": b - a, "score": x} for a, b, x in found]] if with_spans else []), *rest

        return step

    return map_rows(docs.select(F.col(id_col).alias("a"), F.col(text_col).alias("b"), (remainder(id_col, FOLDS) == 0).alias("c"), *(F.col(f"`{c}`").alias(f"carry{k}") for k, c in enumerate(carry))), schema, start)
