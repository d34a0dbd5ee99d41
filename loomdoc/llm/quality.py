"""Quality rules: a table of thresholds compiled into one projection.

Words are runs of anything but space and U+0009 to U+000D. A null or wordless
text has zero counts and fails the base rule. Each row is judged by itself:
repeated rows get equal verdicts, extra columns are ignored, and the whole text
counts whatever its length. A ratio of nothing is 0. Values equal to a bound
pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import SPACES, words

#: Words in a window of the repetition count.
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = "the of and to in is that it for was on are as with be by this der die und das den von zu mit sich des ist im dem nicht ein eine la le les de et des un une que qui dans en du est pour el los las y por con para del se".split()


@dataclass(frozen=True)
class Rule:
    """low <= measure <= high, for texts of at least min_words words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0

    def passes(self) -> Column:
        m = F.col(self.measure)
        ok = F.lit(True)
        if self.low is not None:
            ok &= m >= self.low
        if self.high is not None:
            ok &= m <= self.high
        return ok if not self.min_words else (F.col("n_words") < self.min_words) | ok


#: The thresholds. Measures are columns of measures().
RULES = (
    Rule("words", "n_words", 10),
    Rule("word_length", "mean_word_chars", 2, 15),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "n_stop_words", 2, None, 50),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5, 0),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3, 0),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9, 0),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every measure the rules can use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    w = words(text)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), w.alias("w"))
    # one hash a word; 64 bits tell the windows of one text apart
    hashed = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"[{SPACES}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    last = F.size("h") - WINDOW
    windowed = hashed.select(
        "*",
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.col("h")[i + k] for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    ).drop("h")
    # only a text with a window found twice sorts its windows
    sorted_ = windowed.select("*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s")).drop("windows")
    same = lambda x, k: F.coalesce(F.get(F.col("s"), k)["h"] == x["h"], F.lit(False))
    places = sorted_.select("*", F.sort_array(F.transform(F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])).alias("p")).drop("s")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n_lines = F.size("lines")
    return places.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_stop_words",
        n_lines.cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: x.rlike("^ *[-*•]"))).cast("long").alias("n_bullet_lines"),
    ).select(
        "*",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("n_ellipsis_lines"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        ratio(F.col("n_bullet_lines"), F.col("n_lines")).alias("bullet_line_ratio"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, base_failed, the rules each row fails, and kept."""
    m = measures(docs, id_col, text_col)
    failed = F.array_compact(F.array(*(F.when(~r.passes(), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.select("*", base.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def oracle() -> str:
    """The registered query in DuckDB; the rules of RULES are written out by the table's own values."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    conditions = []
    for r in RULES:
        parts = [f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)
        conditions.append(f"(n_words < {r.min_words} OR {' AND '.join(parts)})" if r.min_words else f"({' AND '.join(parts)})")
    blank = " || ".join(["' '", *(f"chr({i})" for i in range(9, 14))])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(translate(coalesce(text, ''), {blank}, '      '), ' '), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words, list_filter(string_split(t, chr(10)), lambda x: trim(translate(x, {blank}, '      ')) <> '') AS lines FROM d),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, x || ' ' || lead(x, 1) OVER b || ' ' || lead(x, 2) OVER b || ' ' || lead(x, 3) OVER b || ' ' || lead(x, 4) OVER b AS g FROM p WINDOW b AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c >= 2),
r AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM f, range(0, {WINDOW}) AS s(k) GROUP BY doc_id),
m AS (SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_stop_words,
  len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '(\\.\\.\\.|…)$'))) AS n_ell, len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bul, len(lines) AS n_lines FROM i LEFT JOIN r USING (doc_id)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_lines > 0 THEN n_ell / n_lines ELSE 0 END AS ellipsis_line_ratio, CASE WHEN n_lines > 0 THEN n_bul / n_lines ELSE 0 END AS bullet_line_ratio, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(conditions)} AS kept FROM q"""
