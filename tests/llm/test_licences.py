"""Licence scans: wrapped and embedded texts, changed words, families, odd rows, and the SQL on a fixture."""

import textwrap

import duckdb
import pytest

from loomdoc.llm import licences as L

TEXT = {(name, family): text for name, family, text in L.TEMPLATES}
GRANT, WARRANTY = [t for n, _, t in L.TEMPLATES if n == "mit"][2:]
MIT = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + "\n\n".join(textwrap.fill(t, 78) for t in (GRANT, WARRANTY))
BSD2, BSD3 = TEXT["bsd-2-clause", "bsd"], TEXT["bsd-3-clause", "bsd"]
GPL2, GPL3 = TEXT["gpl-2.0", "gnu"], TEXT["gpl-3.0", "gnu"]


def commented(text, mark="# "):
    return "\n".join(mark + x for x in textwrap.wrap(text, 60))


ROWS = [
    (1, MIT, 2, "mit"),
    (2, "some words before " * 30 + commented(MIT, " * ") + "\nint main() { return 0; }" * 20, 2, "mit"),
    (3, GRANT.replace("sublicense", "resell").replace("furnished", "given").replace("substantial", "large"), 1, "mit"),
    (4, textwrap.fill(BSD3, 60), 1, "bsd-3-clause"),
    (5, BSD2, 1, "bsd-2-clause"),
    (6, f"{commented(GPL3)}\ncode\n{commented(GPL2)}", 2, "gpl-2.0,gpl-3.0"),
    (7, "Licensed under CC BY-NC 4.0.\nother\nLicensed under CC BY-NC 4.0.", 2, "cc-by-nc-4.0"),
    (8, "Text of its own. Released under the MIT License. All rights reserved.", 2, "all-rights-reserved,mit"),
    (9, "the software is free and the license is good, subject to nothing", 0, ""),
    (10, GRANT[: len(GRANT) // 2], 0, ""),
    (11, None, 0, ""),
    (12, "", 0, ""),
    (13, " -- \n", 0, ""),
    (14, "license", 0, ""),
    (14, "license", 0, ""),
    (None, "All rights reserved", 1, "all-rights-reserved"),
    (15, "word " * 50_000 + "all rights reserved", 1, "all-rights-reserved"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t, _, _ in ROWS], "doc_id long, text string, licenses string, hits int")


def test_licences_are_found_wherever_they_stand(docs):
    got = sorted(((r.doc_id or 0, r.n_license_units, r.licenses) for r in L.scan(docs).collect()))
    assert got == sorted((i or 0, n, names) for i, _, n, names in ROWS)


def test_hits_tell_the_place(docs):
    hits = {r.doc_id: r.hits for r in L.scan(docs).collect()}
    assert [(h.license, h["first"], h.words, h.dice) for h in hits[7]] == [("cc-by-nc-4.0", 0, 6 + 1, 1.0), ("cc-by-nc-4.0", 8, 7, 1.0)]
    assert 0.8 <= hits[3][0].dice < 1


def test_no_templates_and_no_rows(docs):
    assert {r.n_license_units for r in L.scan(docs, ()).collect()} == {0}
    assert L.scan(docs.limit(0)).count() == 0


def test_fixture_equals_the_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id IS NOT NULL").distinct().toPandas())
    want = {tuple(r) for r in con.sql(L.oracle()).fetchall()}
    assert {tuple(r) for r in L.scan(docs.where("doc_id IS NOT NULL")).select("doc_id", "n_license_units", "licenses").collect()} == want
