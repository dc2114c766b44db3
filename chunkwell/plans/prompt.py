"""Prompts within a token budget, as columns and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.functions.text import strip, token_estimate

MAX_TOKENS = 15000
SYSTEM = """
You answer questions about a collection of source files.
Use only the numbered excerpts below and the conversation so far; say so when they do not hold the answer.
After each statement name its source as [FILE: <file_path>, LINES: <start_line>-<end_line>].
Put code in fenced blocks, and keep to the question.
"""
SUBQUESTION_SYSTEM = """
You split a question about a collection of source files into 3 to 7 smaller ones.
Each must ask for one thing, be fit for a search, use the words of the excerpts, and repeat nothing already answered.
Reply with a JSON object only: {"subquestions": ["...", "..."]}
"""
#: The answer when nothing was found, and how such answers are told.
NOT_FOUND = "I could not find any relevant information in the codebase for your query."
NOT_FOUND_MARK = "I could not find any relevant information"


def history_text(turns: Column) -> Column:
    """Conversation text from an array of (query, response); empty for none.  Its labels are fixed values."""
    lines = F.transform(
        turns,
        lambda t, i: F.concat(
            F.lit("User (Turn "), (i + 1).cast("string"), F.lit("): "), F.coalesce(t["query"], F.lit("")),
            F.lit("\nAssistant (Turn "), (i + 1).cast("string"), F.lit("): "), F.coalesce(t["response"], F.lit("")),
        ),
    )
    return F.when(F.size(turns) > 0, F.concat(F.lit("Conversation History:\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")


def chunk_text() -> Column:
    """A chunk as it stands in a prompt, a fixed format; nulls are empty."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.concat(
        F.lit("\n<DOC_START>\nFile: "), part("file_path"), F.lit("\nLanguage: "), part("language"), F.lit("\nType: "), part("chunk_type"), F.lit(" "), part("name"),
        F.lit(" (Parent: "), part("parent_name"), F.lit(")\nLines: "), part("start_line"), F.lit("-"), part("end_line"), F.lit("\n\n"), part("content"), F.lit("\n<DOC_END>\n"),
    )


def within_budget(rows: DataFrame, base: Column | int, limit: int = MAX_TOKENS, tokens: str = "tokens", order: str = "place", key: list[str] | None = None) -> DataFrame:
    """The rows before the first that would reach the limit: running sums rise, so a comparison finds them."""
    window = Window.partitionBy(*(key or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.lit(base) if isinstance(base, int) else base
    return rows.withColumn("_sum", F.sum(tokens).over(window)).where(base + F.col("_sum") < limit).drop("_sum")


#: The labels before a question, before its excerpts, and the same where sub-questions are asked for.
QUERY_LABEL, CONTEXT_LABEL = "User Query: ", "Relevant Code Context:"
FIRST_QUERY_LABEL, FIRST_CONTEXT_LABEL = "Original User Query: ", "Initial Code Context:"
ANSWER_NOW = "Answer the query above from these excerpts, as the instructions say."
SPLIT_NOW = "Reply with the JSON object of smaller questions now."


def _assemble(hits: DataFrame, questions: DataFrame, key: list[str], system: str, labels: tuple[str, str], counted: bool, ending: str, limit: int) -> DataFrame:
    """A row (key, prompt, chunks) for each question (key, query, history), from the hits (key, place, chunk columns) of its own that fit."""
    label, context = labels
    base = token_estimate(F.lit(system)) + token_estimate(F.concat(F.lit(label), F.col("query"), F.lit("\n\n" + context)))
    if counted:
        base = base + token_estimate("history")
    texts = hits.select(*key, "place", chunk_text().alias("text")).withColumn("tokens", token_estimate("text"))
    kept = within_budget(texts.join(questions.select(*key, base.alias("_base")), key) if key else texts.crossJoin(questions.select(base.alias("_base"))), F.col("_base"), limit, key=key)
    joined = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("c"))  # within the budget
    rows = questions.join(joined, key, "left") if key else questions.crossJoin(joined)
    rows = rows.withColumn("c", F.coalesce("c", F.array().cast("array<struct<place: int, text: string>>")))
    body = F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")
    prompt = F.concat(F.lit(system + "\n\n---\n"), F.col("history"), F.lit(label), F.col("query"), F.lit("\n\n" + context + "\n"), body, F.lit("\n\n---\n" + ending + "\n"))
    return rows.select(*key, strip(prompt).alias("prompt"), F.size("c").alias("chunks"))


def _one(hits: DataFrame, query: str, history: Column | None) -> DataFrame:
    return hits.sparkSession.range(1).select(F.lit(query).alias("query"), (history if history is not None else F.lit("")).alias("history"))


def rag_prompt(hits: DataFrame, query: str, history: Column | None = None, system: str = SYSTEM, limit: int = MAX_TOKENS) -> DataFrame:
    """One row (prompt, chunks) from hits (place, chunk columns); the history's tokens are not counted."""
    return _assemble(hits, _one(hits, query, history), [], system, (QUERY_LABEL, CONTEXT_LABEL), False, ANSWER_NOW, limit)


def rag_prompts(hits: DataFrame, questions: DataFrame, key: str, system: str = SYSTEM, limit: int = MAX_TOKENS) -> DataFrame:
    """A row (key, prompt, chunks) for each of many questions (key, query, history) from the hits of each."""
    return _assemble(hits, questions, [key], system, (QUERY_LABEL, CONTEXT_LABEL), False, ANSWER_NOW, limit)


def subquestion_prompt(hits: DataFrame, query: str, history: Column | None = None, system: str = SUBQUESTION_SYSTEM, limit: int = MAX_TOKENS) -> DataFrame:
    """One row (prompt, chunks) that asks for sub-questions; the history's tokens are counted."""
    return _assemble(hits, _one(hits, query, history), [], system, (FIRST_QUERY_LABEL, FIRST_CONTEXT_LABEL), True, SPLIT_NOW, limit)


def subquestion_prompts(hits: DataFrame, questions: DataFrame, key: str, system: str = SUBQUESTION_SYSTEM, limit: int = MAX_TOKENS) -> DataFrame:
    """A row (key, prompt, chunks) for each of many questions (key, query, history) that asks for its sub-questions."""
    return _assemble(hits, questions, [key], system, (FIRST_QUERY_LABEL, FIRST_CONTEXT_LABEL), True, SPLIT_NOW, limit)


def is_not_found(answer: Column | str) -> Column:
    return (F.col(answer) if isinstance(answer, str) else answer).contains(NOT_FOUND_MARK)
