"""MDX to Markdown with component markers, as one column expression.

Fenced code is set aside under numbered place holders, comments, imports and
exports go, components become marker lines with cleaned props, simple inline
expressions keep their value, and the fences come back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions.text import col, strip

# The syntax of MDX and of the markers.
FENCE = r"(?s)(```.*?```|~~~.*?~~~)"
PROP = r"""([A-Za-z_:][A-Za-z0-9_:.-]*)\s*=\s*("[^"]*"|'[^']*'|\{[^{}]*\})"""
NAME = r"([A-Z][A-Za-z0-9_.]*)"
MARKER = "::mdx-component-"
_OPEN, _SHUT = "\u0001", "\u0002"


def _hold(i: Column) -> Column:
    return F.concat(F.lit("@@FENCE_"), i.cast("string"), F.lit("@@"))


def prop_value(raw: Column) -> Column:
    """A quoted or braced literal's value; empty for any other expression."""
    v = strip(raw)
    inner = strip(F.substring(v, 2, F.length(v) - 2))
    quoted = lambda x: x.rlike(r"""(?s)^["'].*["']$""")
    cut = lambda x: F.substring(x, 2, F.length(x) - 2)
    return F.when(quoted(v), inner).when(v.rlike(r"(?s)^\{.*\}$"), F.when(quoted(inner), strip(cut(inner))).when(inner.rlike(r"^[A-Za-z0-9_.$:/\-\s]+$"), inner).otherwise("")).otherwise(v)


def props(raw: Column) -> Column:
    """array<struct<key, value>> of the props with a value; of a repeated key the last value at the first place."""
    keys, values = (F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(PROP), k) for k in (1, 2))
    pairs = F.filter(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), prop_value(v).alias("value"))), lambda p: p["value"] != "")
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))


def serialised(raw: Column) -> Column:
    parts = F.transform(props(raw), lambda p: F.concat(F.lit(" "), p["key"], F.lit('="'), strip(F.replace(p["value"], F.lit('"'), F.lit("'"))), F.lit('"')))
    return F.array_join(parts, "")


def drop_exports(c: Column) -> Column:
    """Export lines and blocks out: a block runs until its braces balance after its first line."""
    lines = F.split(c, "\n")
    depth = lambda x: (F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit(""))) - F.length(x) + F.length(F.replace(x, F.lit("}"), F.lit("")))).cast("int")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"), F.lit(0).alias("depth"))

    def step(a: Column, x: Column) -> Column:
        t = strip(x)
        starts = ~a["skip"] & t.startswith("export ")
        block = starts & F.contains(x, F.lit("{")) & ~t.endswith(";")
        d = F.when(block, depth(x)).when(a["skip"], a["depth"] + depth(x)).otherwise(0)
        return F.struct(
            F.when(starts | a["skip"], a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out"),
            (block | (a["skip"] & (d > 0))).alias("skip"),
            F.when(block | (a["skip"] & (d > 0)), d).otherwise(0).alias("depth"),
        )

    # most texts have no export, and then nothing is folded
    return F.when(c.rlike(r"(?m)^\s*export "), F.aggregate(lines, zero, step, lambda a: F.array_join(a["out"], "\n"))).otherwise(c)


def _marked(c: Column, pattern: str, kind: str, attributes: bool) -> Column:
    body = f"{_OPEN}$2{_SHUT}" if attributes else ""
    t = F.regexp_replace(c, pattern, f'\n\n{MARKER}{kind} name="$1"{body}\n\n')
    if not attributes:
        return t
    pieces = F.split(t, f"[{_OPEN}{_SHUT}]")  # every second piece is a component's attributes
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, serialised(x)).otherwise(x)), "")


def components(c: Column) -> Column:
    """Self-closing, then opening, then closing tags of components as marker lines."""
    t = _marked(c, f"<{NAME}\\b([^<>]*)/>", "self", True)
    t = _marked(t, f"<{NAME}\\b([^<>]*)>", "open", True)
    return _marked(t, f"</{NAME}>", "close", False)


def expressions(c: Column) -> Column:
    """{"text"} and {simple.value} keep their value, other inline expressions go."""
    t = F.regexp_replace(c, r"""\{\s*["']([^{}\n]*)["']\s*\}""", f"{_OPEN}$1{_SHUT}")
    t = F.regexp_replace(t, r"\{\s*([A-Za-z0-9_.$:/\-]+)\s*\}", f"{_OPEN}$1{_SHUT}")
    return F.regexp_replace(F.regexp_replace(t, r"\{[^{}\n]+\}", ""), f"[{_OPEN}{_SHUT}]", "")


def spacing(c: Column) -> Column:
    """Lines without trailing white space, at most two blank ones in a row, one newline at the end."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.concat(strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{4,}", "\n\n\n")), F.lit("\n"))


def normalize_mdx(c: Column | str) -> Column:
    """The whole normalisation; empty for an empty text."""
    t = col(c)
    fences = F.regexp_extract_all(t, F.lit(FENCE), 1)
    parts = F.split(t, FENCE, -1)
    held = F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(fences), F.concat(p, _hold(i))).otherwise(p)), "")
    held = F.regexp_replace(F.regexp_replace(held, "(?s)<!--.*?-->", ""), r"(?s)\{/\*.*?\*/\}", "")
    held = F.regexp_replace(held, r"(?m)^\s*import[^\S\n]+.*$", "")
    held = expressions(components(drop_exports(held)))
    numbered = F.transform(fences, lambda f, i: F.struct(_hold(i).alias("k"), f.alias("f")))
    back = F.aggregate(numbered, held, lambda a, x: F.replace(a, x["k"], x["f"]))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("")).otherwise(spacing(back))
