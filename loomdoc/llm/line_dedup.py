"""Line dedup by site-relative frequency.

For every host (a null host is one of its own) and line (outer blanks apart),
the share of the host's pages that hold the line. Lines on more than `ratio` of
the host's pages, and on at least `min_pages` of them, are boilerplate and go
from every page of the host; blank lines stay. A page counts once however often
it repeats a line. Null texts stay null, with no lines; a page may end up empty;
repeated rows count as pages of their own; an empty table stays empty. Other columns
pass through untouched, but for one that has the name of a count: the count
takes its place.

A host has at most (lines a page) / ratio such lines, so its list is bounded; it
is joined by host, as a broadcast while all hosts' lists hold at most
`broadcast_lines` lines and else as a shuffled join whose pages are salted.
Lines are compared by a 64-bit hash within a host's list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.session import written

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.02
#: Least pages that hold a boilerplate line.
MIN_PAGES = 5
#: Most lines in all hosts' lists for a broadcast (16 bytes each).
BROADCAST_LINES = 200_000
#: Parts that a host's pages are dealt out to beyond that.
SALTS = 64


def _key(line):
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """host, line_key, pages and total of every boilerplate line."""
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("t"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), _key))).alias("line_key"))
    counts = lines.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    joined = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return joined.where(F.col("pages") > ratio * F.col("total")).select("c.host", "line_key", "pages", "total")


def dedup_lines(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", counts: tuple[str, str] | None = ("n_lines", "n_dropped"), broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with their boilerplate lines gone; counts names two added columns."""
    found = written(boilerplate(docs, ratio, min_pages, host_col, text_col), "boilerplate")
    small = found.count() <= broadcast_lines
    lists = found.groupBy("host").agg(F.collect_list("line_key").alias("_drop")).withColumnRenamed("host", "_host")
    d = docs.alias("d")
    host = F.col(f"d.`{host_col}`").cast("string")
    if small:
        joined = d.join(F.broadcast(lists.alias("l")), host.eqNullSafe(F.col("l._host")), "left")
    else:
        lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col(f"d.`{text_col}`")), F.lit(SALTS)).cast("int")
        joined = d.join(lists.alias("l"), host.eqNullSafe(F.col("l._host")) & (salt == F.col("l._salt")), "left")
    t = F.col(f"d.`{text_col}`")
    kept = F.filter(F.split(t, "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("l._drop"), _key(x)))
    new = F.when(F.col("l._drop").isNull(), t).otherwise(F.array_join(kept, "\n"))
    columns = [(new.alias(c) if c == text_col else F.col(f"d.`{c}`")) for c in docs.columns if not counts or c not in counts]
    if not counts:
        return joined.select(*columns)
    n_lines = F.when(t.isNull(), 0).otherwise(F.size(F.split(t, "\n")))
    n_kept = F.when(t.isNull(), 0).when(F.col("l._drop").isNull(), n_lines).otherwise(F.size(kept))
    return joined.select(*columns, n_lines.cast("long").alias(counts[0]), (n_lines - n_kept).cast("long").alias(counts[1]))


def oracle(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The query over documents in DuckDB."""
    return f"""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
tot AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT source, trim(line) AS k FROM l JOIN tot USING (source) WHERE trim(line) <> '' GROUP BY source, trim(line), total HAVING count(DISTINCT doc_id) >= {min_pages} AND count(DISTINCT doc_id) > {ratio} * total),
k AS (SELECT l.doc_id, l.line, l.pos, b.k IS NOT NULL AS dropped FROM l LEFT JOIN b ON l.source = b.source AND trim(l.line) = b.k),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE g.text END AS text, d.source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN g USING (doc_id)"""
