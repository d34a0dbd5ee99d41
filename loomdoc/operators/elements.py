"""Markdown text to ordered block elements.

Lines are classified by their look, in one pass over each document's lines
inside its row, so documents never meet and nothing is shuffled. Leading white
space is taken as gone (cleaning strips it), so there is no nesting by indent
and no indented code. Known bounds: reference definitions and nested quotes are
plain text; a quote's marks are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT = "struct<pos:int,type:string,level:int,text:string,items:array<string>,ordered:boolean,rows:array<array<string>>,language:string,name:string,props:array<struct<key:string,value:string>>>"

_FENCE = re.compile(r"^(`{3,}|~{3,})\s*([^`]*)$")
_HEADING = re.compile(r"^(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_BULLET = re.compile(r"^([-*+])\s+(.*)$")
_NUMBER = re.compile(r"^(\d{1,9})([.)])\s+(.*)$")
_RULE = re.compile(r"^(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_DELIMITER = re.compile(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$")
_MARKER = re.compile(r"^::mdx-component-(open|close|self)\s+(.*)$")
_ATTRIBUTE = re.compile(r'([A-Za-z_:][A-Za-z0-9_:.-]*)="([^"]*)"')


def _element(kind: str, **values) -> dict:
    return {"type": kind, "level": None, "text": None, "items": None, "ordered": None, "rows": None, "language": None, "name": None, "props": None} | values


class Blocks:
    """The open block of one document, and the elements before it."""

    def __init__(self) -> None:
        self.done: list[dict] = []
        self.open: dict | None = None

    def close(self) -> None:
        if self.open:
            kind = self.open["type"]
            if kind == "paragraph":
                self.open["text"] = "\n".join(self.open.pop("lines")).strip()
            self.open.pop("mark", None)
            if kind == "code":
                self.open["text"] = "\n".join(self.open.pop("lines")).rstrip("\n")
                self.open.pop("fence")
            self.done.append(self.open)
        self.open = None

    def emit(self, kind: str, **values) -> None:
        self.close()
        self.done.append(_element(kind, **values))

    def is_open(self, kind: str) -> bool:
        return self.open is not None and self.open["type"] == kind


def _cells(line: str) -> list[str]:
    body = line[1:] if line.startswith("|") else line
    return [c.strip() for c in (body[:-1] if body.endswith("|") else body).split("|")]


def parse(text: str | None) -> list[dict]:
    """The elements of one cleaned text."""
    b = Blocks()
    lines = (text or "").split("\n")
    blank_before = False
    for k, raw in enumerate(lines):
        if b.is_open("code"):
            shut = _FENCE.match(raw.strip())
            if shut and shut[1][0] == b.open["fence"][0] and len(shut[1]) >= len(b.open["fence"]) and not shut[2]:
                b.close()
            else:
                b.open["lines"].append(raw)
            continue
        line = raw.strip()
        while line.startswith(">"):
            line = line[1:].strip()
        after_blank, blank_before = blank_before, not line
        if not line:
            if not b.is_open("list"):
                b.close()
            continue
        if m := _FENCE.match(line):
            b.close()
            b.open = _element("code", language=m[2].strip(), lines=[], fence=m[1])
        elif m := _MARKER.match(line):
            props = dict(_ATTRIBUTE.findall(m[2]))
            name = props.pop("name", "")
            b.emit(f"component_{m[1]}", name=name, props=[{"key": a, "value": v} for a, v in props.items()])
        elif b.is_open("table"):
            if "|" in line:
                b.open["rows"].append(_cells(line))
            else:
                b.close()
                b.open = _element("paragraph", lines=[line])
        elif b.is_open("paragraph") and (re.fullmatch(r"=+", line) or re.fullmatch(r"-+", line)):
            b.open["text"] = "\n".join(b.open.pop("lines"))
            b.open |= {"type": "heading", "level": 1 if line[0] == "=" else 2}
            b.close()
        elif m := _HEADING.match(line):
            b.emit("heading", level=len(m[1]), text=(m[2] or "").strip())
        elif _RULE.match(line):
            b.close()
        elif "|" in line and k + 1 < len(lines) and "-" in lines[k + 1] and _DELIMITER.match(lines[k + 1].strip()) and len(_cells(lines[k + 1].strip())) == len(_cells(line)):
            b.close()
            b.open = _element("table", rows=[_cells(line)])
        elif (m := _BULLET.match(line)) or (m := _NUMBER.match(line)) and not (b.is_open("paragraph") and m[1] != "1"):
            ordered = m.re is _NUMBER
            mark = m[2 if ordered else 1]  # another bullet or delimiter begins another list
            if not (b.is_open("list") and b.open["mark"] == mark):
                b.close()
                b.open = _element("list", items=[], ordered=ordered, mark=mark)
            b.open["items"].append(m[3 if ordered else 2].strip())
        elif b.is_open("list") and not after_blank:
            b.open["items"][-1] += f"\n{line}"  # a lazy line belongs to the item
        elif b.is_open("paragraph"):
            b.open["lines"].append(line)
        else:
            b.close()
            b.open = _element("paragraph", lines=[line])
    b.close()
    for e in b.done:
        if e["type"] == "table":
            e["rows"] = [r for j, r in enumerate(e["rows"]) if j != 1]  # the delimiter row
    kept = [e for e in b.done if e["type"] not in ("paragraph", "code", "list") or e["text"] or e["items"]]
    return [{"pos": k, **e} for k, e in enumerate(kept)]


def grouped(found: list[dict]) -> list[dict]:
    """The elements by heading section: section_index, heading, path (the heading's ancestors) and content; sections without content, too."""
    out = [{"section_index": 0, "heading": "Overview", "path": [], "content": []}]
    above: list[tuple[int, str]] = []
    for e in found:
        if e["type"] == "heading":
            while above and above[-1][0] >= e["level"]:
                above.pop()
            out.append({"section_index": len(out), "heading": e["text"], "path": [t for _, t in above], "content": []})
            above.append((e["level"], e["text"]))
        else:
            out[-1]["content"].append(e)
    return out


def sectioned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `sections`, its sections with content in order; one row for each document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"doc_id": df["doc_id"], "sections": df["t"].map(lambda t: [x for x in grouped(parse(t)) if x["content"]])})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInPandas(run, f"doc_id {id_type}, sections array<struct<section_index:int,heading:string,path:array<string>,content:array<{ELEMENT}>>>")


def parse_elements(c: Column) -> Column:
    """The elements of each text, as an array column."""

    @F.pandas_udf(f"array<{ELEMENT}>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(parse)

    return run(c)


def elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each element: doc_id, pos and the element's fields."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(parse_elements(F.col(text_col))).alias("e")).select("doc_id", "e.*")
