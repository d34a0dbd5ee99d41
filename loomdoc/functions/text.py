"""Text columns: cleaning, splitting, token estimates, keywords, ids.

All are compositions of JVM expressions. Empty and null texts count as absent,
as the callers' truthiness rules want.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
KEYWORD_STOPS = ("this", "that", "with", "have", "from", "using", "into", "your", "will", "when", "where", "what", "which", "then", "than", "also", "more", "only", "used", "like", "such", "these", "those")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without outer white space."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space as one space, outer ones gone."""
    return strip(F.regexp_replace(col(c), r"\s+", " "))


def split_words(c: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda w: w != "")


def clean_markdown(c: Column | str) -> Column:
    """Images and tags out, links to their text, lines stripped, notice lines out, at most one blank line."""
    t = F.regexp_replace(col(c), r"!\[.*?\]\(.*?\)", "")
    t = F.regexp_replace(t, r"\[(.*?)\]\(.*?\)", "$1")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: ~x.startswith("**Applies to:**"))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def clean_inline(c: Column | str) -> Column:
    """Bold, italics and links to their text; blanks squeezed."""
    t = col(c)
    for pattern in (r"\*\*(.*?)\*\*", r"\*(.*?)\*", r"\[(.*?)\]\(.*?\)"):
        t = F.regexp_replace(t, pattern, "$1")
    return clean_text(t)


def clean_text(c: Column | str) -> Column:
    """Blanks and tabs squeezed, at most one blank line, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_cell(c: Column | str) -> Column:
    """A table cell: white space collapsed, emphasis out."""
    t = collapse(F.coalesce(col(c), F.lit("")))
    return F.regexp_replace(F.regexp_replace(t, r"\*\*(.*?)\*\*", "$1"), r"\*(.*?)\*", "$1")


def list_item(c: Column | str) -> Column:
    """A list item without its bullet."""
    return collapse(F.regexp_replace(strip(c), "^[-*• ]+", ""))


def step_item(c: Column | str) -> Column:
    """A procedure step without its bullet mark and its number."""
    return collapse(F.regexp_replace(F.regexp_replace(strip(c), r"^\s*[-*•]\s*", ""), r"^\s*\d+[.)]\s*", ""))


def slug(c: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "`", ""), "[^a-z0-9]+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.when(t == "", F.lit("section")).otherwise(t)


def join_present(parts: list[Column], sep: str) -> Column:
    """The parts that are not null or empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def sentences(c: Column | str) -> Column:
    """Split after . ! or ? and white space; blank pieces out."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def tokens(c: Column | str) -> Column:
    """Estimated tokens: a quarter of the characters, at least 1; 0 for none."""
    n = F.length(F.coalesce(col(c), F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def keywords(c: Column | str, limit: int = 12, least: int = 4) -> Column:
    """The first distinct words of letters, digits and ._- from a letter on, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(rf"\b([a-z][a-z0-9._-]{{{least - 1},}})\b"), 1)
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(*KEYWORD_STOPS))), 1, limit)


def chunk_id(source: Column, heading: Column, context: Column, text: Column) -> Column:
    blank = lambda x: F.coalesce(x, F.lit(""))
    return F.md5(F.concat_ws("|", blank(source), blank(heading), blank(context), F.substring(blank(text), 1, 120)))


def point_id(source: Column, heading: Column, context: Column, subtype: Column, split_part: Column, text: Column) -> Column:
    """A UUID from the first 16 bytes of a SHA-1; a part number of 0 counts as none."""
    part = F.when(split_part != 0, split_part.cast("string"))
    h = F.sha1(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (source, heading, context, subtype, part)), F.substring(F.coalesce(text, F.lit("")), 1, 200)))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def prefix(context: Column, heading: Column) -> Column:
    """`context - heading`, or the context alone where it holds the heading."""
    c, h = (strip(F.coalesce(x, F.lit(""))) for x in (context, heading))
    return F.when(c == "", h).when((h == "") | F.contains(F.lower(c), F.lower(h)), c).otherwise(F.concat(c, F.lit(" - "), h))


def preview(c: Column | str, n: int = 120) -> Column:
    t = strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), "\n", " "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def pack(parts: Column, limit: int | Column, sep: str = " ") -> Column:
    """Greedy groups: a part opens a new group when the open one is not empty and would pass the limit.

    The fold runs over token counts and keeps the places where groups begin, so
    no text is copied before its group is joined.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        opens = (acc["at"] == 0) | (acc["n"] + t > limit)
        return F.struct(F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"), (acc["at"] + 1).alias("at"), F.when(opens, t).otherwise(acc["n"] + t).alias("n"))

    def groups(p: Column) -> Column:
        starts = F.aggregate(F.transform(p, tokens), zero, step, lambda acc: acc["starts"])
        return let(starts, lambda s: F.transform(s, lambda first, k: F.array_join(F.slice(p, first + 1, F.coalesce(F.get(s, k + 1), F.size(p)) - first), sep)))

    return let(parts, groups)


def hard_cut(c: Column | str, chars: int) -> Column:
    """Pieces of at most so many characters."""
    t = F.coalesce(col(c), F.lit(""))
    n = F.ceil(F.length(t) / chars).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(t, i * chars + 1, F.lit(chars)))).otherwise(F.array().cast("array<string>"))


def strip_html(c: Column | str) -> Column:
    """Comments, scripts, styles and tags out, white space collapsed."""
    t = F.regexp_replace(col(c), "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, "(?is)<style[^>]*>.*?</style>", " ")
    return collapse(F.regexp_replace(t, "<[^>]+>", " "))
