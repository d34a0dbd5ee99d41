"""Pipe tables as array columns: rows of cells, headers, shape, anomalies, texts and profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions.text import clean_cell, collapse, let, strip


def pipe_row(line: Column) -> Column:
    """Cells of one line; one outer pipe on each side goes, empty cells stay."""
    t = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(t, r"\|"), clean_cell)


def content_rows(rows: Column) -> Column:
    """Rows with content that are no separator rows."""
    some = lambda r: F.exists(r, lambda c: c != "")
    rule = lambda r: F.forall(r, lambda c: (c == "") | c.rlike("^[-: ]+$"))
    return F.filter(rows, lambda r: some(r) & ~rule(r))


def shape(rows: Column) -> Column:
    """Least, largest and most frequent width (of equal ones the larger)."""

    def of(widths: Column) -> Column:
        counted = F.transform(F.array_distinct(widths), lambda w: F.struct(F.size(F.filter(widths, lambda x: x == w)).alias("n"), w.alias("w")))
        return let(F.array_max(counted)["w"], lambda mode: F.struct(mode.alias("target_cols"), F.array_min(widths).alias("min_cols"), F.array_max(widths).alias("max_cols"), mode.alias("mode_cols")))

    return let(F.transform(rows, F.size), of)


def fitted(row: Column, n: Column) -> Column:
    """Padded with empty cells, or cut, to n."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), 1, n)


def headers(row: Column) -> Column:
    """Lower-case names of word characters, `column_i` where there is none, a free suffix where a name is taken."""
    names = F.transform(row, lambda c, i: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)\W+", "_"), "^_+|_+$", ""), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))

    def free(all_names: Column) -> Column:
        """Names in turn; one that is taken gets the first free number, which is no less than the count of its equals."""

        def step(taken: Column, x: Column) -> Column:
            name, nth = x["name"], x["nth"]
            tried = lambda k: F.concat(name, F.lit("_"), k.cast("string"))
            search = F.get(F.filter(F.transform(F.sequence(F.lit(2), F.size(taken) + 2), tried), lambda t: ~F.array_contains(taken, t)), F.lit(0))
            own = F.when(~F.array_contains(taken, name), name).when(~F.array_contains(taken, tried(nth)), tried(nth)).otherwise(search)
            return F.concat(taken, F.array(own))

        # where no name looks like a numbered other one, the numbers can't meet
        numbers = r"_\d+$"
        meet = F.exists(all_names, lambda n: n.rlike(numbers) & F.array_contains(all_names, F.regexp_replace(n, numbers, "")))
        numbered = F.zip_with(all_names, equals_before(all_names), lambda n, k: F.struct(n.alias("name"), k.alias("nth")))
        apart = F.transform(numbered, lambda x: F.when(x["nth"] == 1, x["name"]).otherwise(F.concat(x["name"], F.lit("_"), x["nth"].cast("string"))))
        return F.when(meet, F.aggregate(numbered, F.array().cast("array<string>"), step)).otherwise(apart)

    return let(names, lambda n: F.when(F.size(F.array_distinct(n)) == F.size(n), n).otherwise(free(n)))


def equals_before(names: Column) -> Column:
    """For every name, how many of its equals there are up to it; by one sort."""
    zero = F.struct(F.lit("").alias("name"), F.lit(0).alias("nth"), F.array().cast("array<struct<i:int,nth:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        nth = F.when(a["name"] == x["name"], a["nth"] + 1).otherwise(1)
        return F.struct(x["name"].alias("name"), nth.alias("nth"), F.concat(a["out"], F.array(F.struct(x["i"].alias("i"), nth.alias("nth")))).alias("out"))

    placed = F.array_sort(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("i"))))
    return F.transform(F.array_sort(F.aggregate(placed, zero, step, lambda a: a["out"])), lambda x: x["nth"])


def parse(rows: Column) -> Column:
    """struct<headers, cells, shape, anomalies> of raw rows of cells; null without content."""
    def fit(kept: Column, form: Column) -> Column:
        n = form["target_cols"]
        body = F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1)))
        odd = F.transform(body, lambda r, i: F.when(F.size(r) != n, F.struct((i + 1).cast("int").alias("row_index"), F.when(F.size(r) < n, "short_row").otherwise("long_row").alias("kind"), n.alias("expected_cols"), F.size(r).alias("actual_cols"))))
        value = F.struct(headers(fitted(F.get(kept, F.lit(0)), n)).alias("headers"), F.transform(body, lambda r: fitted(r, n)).alias("cells"), form.alias("shape"), F.array_compact(odd).alias("anomalies"))
        return F.when(F.size(kept) > 0, value)

    return let(content_rows(F.transform(rows, lambda r: F.transform(r, clean_cell))), lambda kept: let(shape(kept), lambda form: fit(kept, form)))


def row_text(names: Column, cells: Column) -> Column:
    """`header: value | ...` without empty values."""
    parts = F.zip_with(names, cells, lambda h, c: let(collapse(F.coalesce(c, F.lit(""))), lambda v: F.when(v != "", F.concat(strip(F.replace(h, F.lit("_"), F.lit(" "))), F.lit(": "), v))))
    return F.array_join(F.array_compact(parts), " | ")


def table_texts(table: Column) -> Column:
    """The texts of the rows with content."""
    return let(table, lambda t: F.filter(F.transform(t["cells"], lambda r: row_text(t["headers"], r)), lambda x: x != ""))


def profile(table: Column) -> Column:
    cells = F.flatten(table["cells"])
    filled = F.size(F.filter(cells, lambda c: c.rlike(r"\S")))
    total = F.size(table["cells"]) * F.size(table["headers"])
    return F.struct(
        F.size(table["cells"]).alias("row_count"),
        F.size(F.filter(table["cells"], lambda r: F.exists(r, lambda c: c.rlike(r"\S")))).alias("non_empty_row_count"),
        F.size(table["headers"]).alias("column_count"),
        filled.alias("filled_cell_count"),
        F.when(total > 0, F.round(filled / total, 4)).otherwise(0.0).alias("cell_density"),
        (F.size(table["anomalies"]) > 0).alias("has_anomalies"),
        F.size(table["anomalies"]).alias("anomaly_count"),
    )
