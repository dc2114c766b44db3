"""Conversations as a table of turns and a table of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns_of(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) -> turns (conv_id, turn from 1, query, response): a user's message and the answer right after."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("_role", F.lead("role").over(order)).withColumn("_text", F.lead("text").over(order))
    rows = rows.where("role = 'user' and _role = 'assistant'")
    n = F.row_number().over(order).cast("int")
    return rows.select("conv_id", n.alias("turn"), F.col("text").alias("query"), F.col("_text").alias("response"))


def history(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """A row for each conversation with its turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "query", "response")))
    return turns.groupBy(key).agg(ordered.alias("turns"))


def add_messages(turns: DataFrame, new: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Append (key, query, response) rows in the order of `at` after the last turn; unknown conversations begin at 1."""
    last = turns.groupBy(key).agg(F.max("turn").alias("_last"))
    order = Window.partitionBy(key).orderBy("at")
    rows = new.join(last, key, "left").withColumn("turn", (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int"))
    return turns.select(key, "turn", "query", "response").union(rows.select(key, "turn", "query", "response"))


def clear(turns: DataFrame, ids: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Turns without those of some conversations; unknown ids change nothing."""
    return turns.join(ids.select(key).distinct(), key, "left_anti")


def conversations(sessions: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Known ids, those without a turn too."""
    return sessions.select(key).distinct()
