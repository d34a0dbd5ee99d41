"""Lexical signals of a text block and the function they imply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions.text import col, let, split_words, strip

# Patterns and word lists of the signals.
FLAG = r"(^|\s)(--[a-zA-Z0-9][a-zA-Z0-9-]*|-[a-zA-Z])(\s|=|$)"
KEY_VALUE = r"^[`'\"]?[a-zA-Z0-9_.\-/ ]+[`'\"]?\s*[:=]\s*.+$"
LABEL = r"^([`'\"]?[A-Za-z][A-Za-z0-9 ._/\-]{1,70}[`'\"]?)\s*:\s*(.+)$"
PATH = r"(^|[\s`'\"])(\.{0,2}/|/|[a-zA-Z0-9_.\-]+/)[a-zA-Z0-9_./\-]+"
ASSIGNMENT = r"\b[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[^,\s]+"
CONFLICT = r"^(<<<<<<<|=======|>>>>>>>)"
SYMBOLS = r"[={}|><$`]"
EXECUTABLE = r"^(\./|/)?[a-z0-9][a-z0-9_.\-/]*$"
EDGES = r"^[`'\"(*\[]+|[`'\":,.;!?)*\]]+$"
STARTERS = ("the", "this", "that", "these", "those", "our", "your", "their", "its", "a", "an", "when", "where", "what", "which", "why", "how", "if", "to", "for", "in", "on", "with", "without")
ACTIONS = ("add", "analyze", "apply", "ask", "build", "check", "choose", "collect", "compare", "configure", "confirm", "copy", "create", "delete", "deploy", "disable", "enable", "fetch", "find", "fix", "generate", "import", "include", "install", "keep", "list", "look", "make", "move", "open", "prefer", "provide", "remove", "replace", "report", "review", "run", "scan", "search", "set", "show", "strip", "summarize", "update", "use", "validate", "verify", "write")
DIRECTIVES = ("do", "do not", "don’t", "dont", "never", "always", "avoid", "ensure", "prefer", "remember")
FLAGS = ("is_command_like", "starts_with_action", "is_labeled_action", "is_directive", "has_flags", "is_key_value", "has_path", "has_assignment", "has_merge_conflict_marker", "is_short", "is_long", "has_numbers", "has_symbols", "sentence_like")


def bare(word: Column) -> Column:
    """A word without outer punctuation."""
    return F.regexp_replace(F.coalesce(word, F.lit("")), EDGES, "")


def _word(text: Column, k: int) -> Column:
    return bare(F.get(split_words(text), k))


def _first(text: Column) -> Column:
    return F.lower(_word(text, 0))


def _acts(text: Column) -> Column:
    return _first(text).isin(*ACTIONS)


def _directs(text: Column) -> Column:
    two = strip(F.concat_ws(" ", _first(text), F.lower(_word(text, 1))))
    return _first(text).isin(*DIRECTIVES) | two.isin(*DIRECTIVES)


def signals(text: Column | str) -> Column:
    """struct of FLAGS and label, of the stripped text."""

    def of(t: Column, w: Column, raw: Column) -> Column:
        n, first = F.size(w), F.lower(raw)
        two = strip(F.concat_ws(" ", first, F.lower(bare(F.get(w, 1)))))
        starters = F.exists(F.slice(w, 1, 3), lambda x: F.lower(bare(x)).isin(*STARTERS))
        facts = F.struct(
            ((n > 0) & (t.rlike(r"[.!?]$") | first.isin(*STARTERS) | (raw.rlike(r"^\p{Lu}") & (n >= 4)))).alias("sentence"),
            t.rlike(FLAG).alias("flags"),
            t.rlike(PATH).alias("path"),
            t.rlike(ASSIGNMENT).alias("assigns"),
            strip(F.regexp_extract(t, f"(?d){LABEL}", 1)).alias("label"),
            strip(F.regexp_extract(t, f"(?d){LABEL}", 2)).alias("body"),
        )

        def signal(f: Column) -> Column:
            shaped = t.rlike("^[$>#] ") | f["flags"] | f["path"] | f["assigns"] | (raw.rlike(EXECUTABLE) & ~starters)
            command = (n >= 2) & (n <= 12) & ~f["sentence"] & (raw != "") & ~first.isin(*STARTERS) & shaped
            labelled = (f["label"] != "") & (f["body"] != "") & (F.size(split_words(f["label"])) <= 6) & (_acts(f["label"]) | _acts(f["body"]) | _directs(f["body"]))
            directive = first.isin(*DIRECTIVES) | two.isin(*DIRECTIVES)
            values = (command, first.isin(*ACTIONS), labelled, directive, f["flags"], t.rlike(f"(?d){KEY_VALUE}"), f["path"], f["assigns"], t.rlike(CONFLICT), n <= 8, n >= 40, t.rlike(r"\p{Nd}"), t.rlike(SYMBOLS), f["sentence"])
            return F.struct(*(v.alias(k) for k, v in zip(FLAGS, values)), strip(bare(f["label"])).alias("label"))

        return let(facts, signal)

    stripped = strip(F.coalesce(col(text), F.lit("")))
    return let(stripped, lambda t: let(split_words(t), lambda w: let(bare(F.get(w, 0)), lambda raw: of(t, w, raw))))


def base_type(kind: Column) -> Column:
    """text, code, list, table or component, of a source block's type."""
    k = F.lower(strip(F.coalesce(kind, F.lit(""))))
    return F.when(k.isin("code", "code_block", "fence"), "code").when(k.isin("list", "bullets", "ordered_list", "unordered_list"), "list").when(k.isin("table", "generic_table"), "table").when(k.isin("component", "mdx_component", "jsx"), "component").otherwise("text")


def form(base: Column, given: Column | None = None) -> Column:
    own = F.when(base == "list", "item").when(base == "table", "row").when(base.isin("code", "component"), "block").otherwise("paragraph")
    return own if given is None else F.coalesce(F.when(given != "", given), own)


def contexts(heading: Column, context: Column, local: Column) -> dict[str, Column]:
    """Whether a block stands under steps, output or overview headings."""
    h, c, x = (F.lower(strip(F.coalesce(v, F.lit("")))) for v in (heading, context, local))
    steps = F.array(h, c, x)
    return {
        "steps": F.exists(steps, lambda v: v.rlike("step|procedure|workflow")) | (h.rlike(r"^\p{Nd}.") & F.contains(F.substring(h, 1, 4), F.lit("."))),
        "output": F.exists(steps, lambda v: v.isin("output", "report", "result", "results", "summary")),
        "overview": (h == "overview") | (c == "overview"),
    }


def function_of(base: Column, text: Column, s: Column, ordered: Column, where: dict[str, Column]) -> Column:
    """struct<function, confidence>: the first rule that holds, in the table's order."""
    is_, any_ = (lambda k: s[k]), F.lit(True)
    code, items, table, part, plain = (base == k for k in ("code", "list", "table", "component", "text"))
    acts, command, flags, path, sentence = (is_(k) for k in ("starts_with_action", "is_command_like", "has_flags", "has_path", "sentence_like"))
    keyed = is_("is_key_value") | is_("has_assignment")
    # Conditions with their function and confidence.
    rules = (
        (strip(F.coalesce(text, F.lit(""))) == "", "mixed", 0.0),
        (is_("has_merge_conflict_marker"), "warning", 0.95),
        (is_("is_labeled_action"), "instruction", 0.88),
        (is_("is_directive"), "instruction", 0.84),
        (table & acts & where["steps"], "instruction", 0.72),
        (table, "reference", 0.84),
        (code & (flags | command), "instruction", 0.88),
        (code & keyed, "configuration", 0.86),
        (code & (path | is_("has_symbols")), "example", 0.78),
        (code, "example", 0.7),
        (items & ordered & acts, "instruction", 0.9),
        (items & ordered & command, "instruction", 0.88),
        (items & acts, "instruction", 0.85),
        (items & command, "instruction", 0.8),
        (items & ordered & ~sentence, "instruction", 0.72),
        (items & flags, "reference", 0.85),
        (items & keyed, "reference", 0.76),
        (items & path, "reference", 0.7),
        (items & sentence, "explanation", 0.65),
        (items & is_("is_short"), "reference", 0.6),
        (items, "mixed", 0.55),
        (part & acts & where["steps"], "instruction", 0.75),
        (part & command, "instruction", 0.75),
        (part & (flags | is_("is_key_value")), "reference", 0.75),
        (part & sentence, "explanation", 0.65),
        (part, "mixed", 0.55),
        (plain & command & ~sentence, "instruction", 0.78),
        (plain & acts & where["steps"], "instruction", 0.78),
        (plain & acts & where["output"], "instruction", 0.72),
        (plain & acts & where["overview"], "explanation", 0.68),
        (plain & flags, "reference", 0.75),
        (plain & keyed, "reference", 0.72),
        (plain & path, "reference", 0.65),
        (plain & (is_("is_long") | sentence), "explanation", 0.7),
        (plain & is_("is_short"), "mixed", 0.55),
        (plain, "explanation", 0.6),
        (any_ & acts & where["steps"], "instruction", 0.65),
        (any_ & command, "instruction", 0.65),
        (any_ & sentence, "explanation", 0.6),
    )
    found = None
    for condition, name, confidence in rules:
        value = F.struct(F.lit(name).alias("function"), F.lit(confidence).alias("confidence"))
        found = F.when(condition, value) if found is None else found.when(condition, value)
    return found.otherwise(F.struct(F.lit("mixed").alias("function"), F.lit(0.5).alias("confidence")))


def retrieval_text(context: Column, heading: Column, local: Column, function: Column, parent_instruction: Column, parent_context: Column, text: Column) -> Column:
    """Labelled lines, without empty ones and without a context that repeats."""
    some = lambda x: F.when(x != "", x)
    c, h, x = some(context), some(heading), some(local)
    lines = (
        ("Context: ", c),
        ("Heading: ", F.when(c.isNull() | (h != c), h)),
        ("Local context: ", F.when((h.isNull() | (x != h)) & (c.isNull() | (x != c)), x)),
        ("Function: ", some(function)),
        ("Parent instruction: ", some(parent_instruction)),
        ("Parent context: ", some(parent_context)),
        ("Text: ", some(text)),
    )
    return F.array_join(F.array_compact(F.array(*(F.concat(F.lit(name), v) for name, v in lines))), "\n")
