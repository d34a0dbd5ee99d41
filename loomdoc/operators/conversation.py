"""Conversation memory, state, query enrichment and prompt assembly over (conv_id, turn, role, text) rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions.text import join_present, split_words, strip

#: Turns that memory keeps (two messages each).
MAX_TURNS = 4

# Phrases by state; matched as substrings, in this order of states. A
# phrase that holds another one of its list is left out, since it matches nowhere else.
DEBUG = ("error", "fail", "not working", "doesn't work", "doesnt work", "isn't working", "isnt working", "bug", "issue", "problem", "broken", "crash", "exception", "stack trace", "traceback", "fix", "solve", "unexpected", "wrong output", "incorrect", "not correct", "timeout", "hang", "stuck", "cannot", "can't", "unable to", "won't run", "won't start", "module not found", "undefined", "null", "none", "segmentation fault", "memory leak")
FOLLOWUP = ("it", "that", "they", "this", "those", "these", "and", "also", "then", "next", "more", "again", "continue", "go on", "what about", "how about", "what if", "how so", "like what", "such as", "for example", "example?", "can you expand", "else", "so?", "now what", "what now", "i mean", "let me rephrase", "actually")
EXPLANATORY = ("why", "how", "explain", "what is", "what are", "what does", "what happens", "what causes", "can you describe", "can you walk me through", "break down", "give overview", "in simple terms", "simplify", "working of", "mechanism of", "difference between", "compare", "what's the difference", "deep dive", "details about", "internals of", "architecture of")
CONFIRMATIONS = ("are you sure", "you sure", "really", "sure?", "is that correct", "confirm that")
# What stands for a history without messages.
NO_HISTORY = "No prior conversation."
# The refusal and the ways of writing it.
REFUSAL = "Apologies, but I don’t have enough information to answer that."
REFUSALS = ("apologies, but i don’t have enough information to answer that.", "apologies, but i don't have enough information to answer that.", "not enough information to answer that")


def memory(messages: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The last 2 * max_turns messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * max_turns).drop("_n")


def summary_due(messages: DataFrame, max_turns: int = MAX_TURNS, every: int = 4) -> DataFrame:
    """due of each message: an answer after which the memory holds a multiple of `every` messages."""
    held = F.least(F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(2 * max_turns))
    return messages.select("conv_id", "turn", "role", held.cast("int").alias("held"), ((F.col("role") == "assistant") & (held >= every) & (held % every == 0)).alias("due"))


def _last(messages: DataFrame, role: str, name: str) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))).alias(name))


def last_answers(messages: DataFrame) -> DataFrame:
    return _last(messages, "assistant", "answer")


def state_of(query: Column, empty: Column) -> Column:
    """new without messages, else debug, followup, explanatory or normal by the last question."""
    q = strip(F.lower(F.coalesce(query, F.lit(""))))
    has = lambda some: F.exists(F.array(*map(F.lit, some)), lambda p: F.contains(q, p))
    return F.when(empty, "new").when(has(DEBUG), "debug").when(has(FOLLOWUP), "followup").when(has(EXPLANATORY), "explanatory").otherwise("normal")


def states(messages: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The state of each conversation, from what its memory holds."""
    return _last(memory(messages, max_turns), "user", "query").select("conv_id", state_of(F.col("query"), F.lit(False)).alias("state"))


def formatted(messages: DataFrame, summaries: DataFrame | None = None, max_turns: int = MAX_TURNS) -> DataFrame:
    """The memory of each conversation as text, below its summary (conv_id, summary) if there is one."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    recent = memory(messages, max_turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit("RECENT CONVERSATION:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    if summaries is None:
        return recent.select("conv_id", body.alias("history"))
    body = F.when(F.col("lines").isNull(), NO_HISTORY).otherwise(body)  # a conversation may be left with its summary alone
    return recent.join(summaries, "conv_id", "full").select("conv_id", F.concat(F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("LONG TERM CONTEXT:\n"), F.col("summary"), F.lit("\n\n"))).otherwise(""), body).alias("history"))


def summarised(messages: DataFrame, summaries: DataFrame, chat, max_turns: int = MAX_TURNS) -> DataFrame:
    """(conv_id, summary) after the conversations' last messages: where an update is due, chat's new summary of the old one and the history; an error keeps the old one.

    Only conversations whose last message is due are put to the model, in the
    workers, in Arrow batches.
    """
    @F.pandas_udf("string")
    def renewed(old: pd.Series, history: pd.Series) -> pd.Series:
        def one(summary: str, text: str) -> str:
            try:
                return chat("Keep the memory of a conversation short: aims, tools and open work; no greetings.", f"Summary so far:\n{summary or 'None'}\n\nNew messages:\n{text}")
            except Exception:  # noqa: BLE001  the model is another service
                return summary

        return pd.Series([one(a, b) for a, b in zip(old, history)])

    due = summary_due(messages, max_turns).groupBy("conv_id").agg(F.max_by("due", "turn").alias("due"))
    rows = due.join(formatted(messages, None, max_turns), "conv_id").join(summaries, "conv_id", "full").withColumn("summary", F.coalesce("summary", F.lit("")))
    new = rows.where("due").select("conv_id", renewed("summary", "history").alias("summary"))
    return new.unionByName(rows.where("NOT coalesce(due, false)").select("conv_id", "summary"))


def enriched(messages: DataFrame, summaries: DataFrame | None = None, max_turns: int = MAX_TURNS) -> DataFrame:
    """The last question of each conversation with 150 characters of its summary and the last other question in memory."""
    recent = memory(messages, max_turns).where("role = 'user'")
    query = _last(messages, "user", "query").where("query IS NOT NULL")
    other = recent.join(query, "conv_id").where("text <> query").groupBy("conv_id").agg(F.max_by("text", "turn").alias("other"))
    df = query.join(other, "conv_id", "left")
    df = df.join(summaries, "conv_id", "left") if summaries is not None else df.withColumn("summary", F.lit(None).cast("string"))
    return df.select("conv_id", join_present([F.col("query"), F.substring("summary", 1, 150), F.col("other")], " ").alias("enriched"))


def is_confirmation(query: Column) -> Column:
    return strip(F.lower(query)).isin(*CONFIRMATIONS)


def guardrail(intent: Column) -> Column:
    """The fixed answer to a question that is not looked up; null for all others."""
    return F.when(intent == "irrelevant", "That is outside what these documents cover.").when(intent == "ambiguous", "The question is not clear; please say more.").when(intent == "meta", "This is an assistant for the indexed documents.")


def context_blocks(results: DataFrame, order: str = "rank") -> DataFrame:
    """query_id and its results as numbered source blocks."""
    c = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("None"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    head = F.concat(F.lit("[Source "), n.cast("string"), F.lit("]\nType: "), c("type"), F.lit("\nHeading: "), c("heading"), F.lit("\nContext: "), c("context"), F.lit("\nScore: "), F.round("score", 3).cast("string"), F.lit("\n\nContent:\n"), c("text"))
    rows = results.select("query_id", n.alias("n"), strip(head).alias("block"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def prompt(state: Column, history: Column, context: Column, intent: Column, query: Column) -> Column:
    """A neutral prompt of tone, history, context, signals and question."""
    tone = F.when(state == "debug", "Look for the cause and say how to mend it.").when(state == "followup", "Go on from the answer before.").when(state == "explanatory", "Explain step by step.").otherwise("Answer directly.")
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:\n"), c))
    return join_present([F.concat(F.lit("Answer from the sources only. "), tone), part("History", history), part("Sources", context), part("Intent", intent), part("Question", query)], "\n\n")


def needs_rewrite(query: Column, least: int = 6) -> Column:
    return F.size(split_words(query)) < least


def state_prefix(state: Column, query: Column) -> Column:
    return F.concat(F.when(state == "followup", "Continue: ").when(state == "debug", "Help fix: ").when(state == "explanatory", "Explain: ").otherwise(""), query)


def verified(answer: Column, review: Column) -> Column:
    """The review, a refusal in one wording, or the answer where it or the review is too short."""
    short = lambda c: F.length(strip(F.coalesce(c, F.lit("")))) < 3
    low = F.lower(strip(review))
    refused = F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(low, p))
    return F.when(short(answer) | short(review), answer).when(refused, REFUSAL).otherwise(strip(review))


def answer(questions: DataFrame, chat, rewrite: bool = True) -> DataFrame:
    """questions (query_id, query, context, state) with rewritten, draft and answer.

    chat(system, user) is called in the workers, in Arrow batches; an error of a
    call leaves what came before it: the query, then an apology, then the draft.
    """
    def ask(system: str, user: str, otherwise: str) -> str:
        try:
            return chat(system, user) or otherwise
        except Exception:  # noqa: BLE001  the model is another service
            return otherwise

    @F.pandas_udf("string")
    def reworded(query: pd.Series, due: pd.Series) -> pd.Series:
        return pd.Series([ask("Rewrite the question so that it stands alone.", q, q) if d else q for q, d in zip(query, due)])

    @F.pandas_udf("string")
    def drafted(text: pd.Series) -> pd.Series:
        return pd.Series([ask("Answer from the sources only.", t, "No answer could be made.") for t in text])

    @F.pandas_udf("string")
    def reviewed(text: pd.Series) -> pd.Series:
        return pd.Series([ask("Review the answer against its sources; give the final answer only.", t, "") for t in text])

    df = questions.withColumn("rewritten", reworded("query", needs_rewrite(F.col("query")) & F.lit(rewrite)))
    df = df.withColumn("draft", drafted(prompt(F.col("state"), F.lit(""), F.col("context"), F.lit(""), state_prefix(F.col("state"), F.col("rewritten")))))
    review = reviewed(F.concat_ws("\n\n", F.col("context"), F.col("query"), F.col("draft")))
    return df.withColumn("_review", review).withColumn("answer", verified(F.col("draft"), F.col("_review"))).drop("_review")
