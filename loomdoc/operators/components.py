"""Component stacks: rendering and folding open and close events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME = "struct<name:string,props:array<struct<key:string,value:string>>>"


def format_props(props: Column) -> Column:
    """k=v; ... by key."""
    return F.array_join(F.transform(F.array_sort(F.filter(props, lambda p: F.coalesce(p["value"], F.lit("")) != "")), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "; ")


def format_frame(frame: Column) -> Column:
    p = format_props(F.coalesce(frame["props"], F.array().cast("array<struct<key:string,value:string>>")))
    return F.when(F.coalesce(frame["name"], F.lit("")) == "", F.lit("")).when(p == "", frame["name"]).otherwise(F.concat(frame["name"], F.lit("("), p, F.lit(")")))


def format_stack(stack: Column) -> Column:
    return F.array_join(F.filter(F.transform(stack, format_frame), lambda x: x != ""), " > ")


def self_closing_text(name: Column, props: Column) -> Column:
    p = format_props(props)
    return F.concat(F.lit("Component: "), name, F.when(p == "", F.lit("")).otherwise(F.concat(F.lit(" ("), p, F.lit(")"))))


def stacks(events: Column) -> Column:
    """The open components after each of an array of elements.

    An open event pushes; a close event cuts back to the nearest frame of its
    name, the top one if it names none, and changes nothing if no frame matches.
    """
    zero = F.struct(F.array().cast(f"array<{FRAME}>").alias("stack"), F.array().cast(f"array<array<{FRAME}>>").alias("all"))

    def step(a: Column, e: Column) -> Column:
        stack = a["stack"]
        depth = F.size(stack)
        match = F.when(F.coalesce(e["name"], F.lit("")) == "", depth).otherwise(F.coalesce(F.array_max(F.transform(stack, lambda f, i: F.when(f["name"] == e["name"], i + 1))), F.lit(0)))
        new = (
            F.when(e["type"] == "component_open", F.concat(stack, F.array(F.struct(e["name"].alias("name"), e["props"].alias("props")))))
            .when((e["type"] == "component_close") & (match > 0), F.slice(stack, F.lit(1), match - 1))
            .otherwise(stack)
        )
        return F.struct(new.alias("stack"), F.concat(a["all"], F.array(new)).alias("all"))

    nested = F.exists(events, lambda e: e["type"].isin("component_open", "component_close"))
    none = F.array().cast(f"array<{FRAME}>")
    return F.when(nested, F.aggregate(events, zero, step, lambda a: a["all"])).otherwise(F.transform(events, lambda e: none))


def merged(stack: Column, local: Column) -> Column:
    """What a stack adds to a block: component_context, component_name and component_props of its innermost frame, and local_context below the components'."""
    context, base = format_stack(stack), F.trim(F.coalesce(local, F.lit("")))
    top = F.when(F.size(stack) > 0, F.element_at(stack, -1))
    whole = F.when((context != "") & (base != ""), F.concat(context, F.lit(" > "), base)).when(context != "", context).otherwise(base)
    return F.struct(context.alias("component_context"), F.coalesce(top["name"], F.lit("")).alias("component_name"), top["props"].alias("component_props"), whole.alias("local_context"))


def resolve(item: Column, meta: Column, section: Column) -> Column:
    """The first of the stacks that is not empty."""
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.coalesce(some(item), some(meta), some(section), F.array().cast(f"array<{FRAME}>"))
