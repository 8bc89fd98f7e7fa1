"""Conversations and messages: histories, recency, titles, turn state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY, TITLE_CHARS, ASKED_CHARS = 6, 80, 200


def with_messages(conversations: DataFrame, messages: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """Each conversation with its messages as an ordered array; none is an empty array."""
    lists = messages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("messages"))
    none = F.array().cast(lists.schema["messages"].dataType)
    return conversations.join(lists, key, "left").withColumn("messages", F.coalesce("messages", none))


def recent(messages: DataFrame, key: str, order: str, n: int = HISTORY) -> DataFrame:
    """The last ``n`` messages of each conversation."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return messages.withColumn("_last", last).filter(F.col("_last") <= n).drop("_last")


def line(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), text)


def history(messages: DataFrame, key: str, order: str, n: int = HISTORY) -> DataFrame:
    """The last ``n`` messages of each conversation as text, oldest first."""
    rows = recent(messages, key, order, n)
    ordered = F.sort_array(F.collect_list(F.struct(order, line(F.col("role"), F.col("text")).alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("history"))


def earlier_turns(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Every message with the lines of all messages before it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("earlier", F.array_join(F.collect_list(line(F.col("role"), F.col("text"))).over(before), "\n"))


def last_user_turn(messages: DataFrame, key: str, order: str) -> DataFrame:
    return messages.filter("role = 'user'").groupBy(key).agg(F.max_by("text", order).alias("last_user"))


def by_recency(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Conversations, the one with the latest message first."""
    return messages.groupBy(key).agg(F.max(order).alias("updated_at")).orderBy(F.desc("updated_at"), key)


def turn_state(messages: DataFrame, key: str, order: str) -> DataFrame:
    """What appending messages implies: title from the first user turn, times, and number of turns."""
    title = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, TITLE_CHARS)), F.when(F.col("role") == "user", F.col(order)))
    return messages.groupBy(key).agg(F.coalesce(title, F.lit("New conversation")).alias("title"), F.min(order).alias("created_at"), F.max(order).alias("updated_at"), F.count(F.lit(1)).alias("n_messages"))


def created(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, user_id, title) and those of ``new`` whose id isn't taken; without a title it is the default."""
    titled = new.select("conv_id", "user_id", F.coalesce(F.nullif(F.trim(F.substring("title", 1, TITLE_CHARS)), F.lit("")), F.lit("New conversation")).alias("title"))
    return conversations.select("conv_id", "user_id", "title").unionByName(titled.join(conversations.select("conv_id"), "conv_id", "left_anti"))


def renamed(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """New titles (conv_id, user_id, title) where the user owns the conversation and the title isn't blank."""
    wanted = changes.groupBy("conv_id", "user_id").agg(F.max("title").alias("_title"))
    cut = F.nullif(F.trim(F.substring("_title", 1, TITLE_CHARS)), F.lit(""))
    return conversations.join(wanted, ["conv_id", "user_id"], "left").withColumn("title", F.coalesce(cut, "title")).drop("_title")


def deleted(conversations: DataFrame, messages: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages without those that their owners removed (conv_id, user_id)."""
    kept = conversations.join(removed.select("conv_id", "user_id"), ["conv_id", "user_id"], "left_anti")
    gone = conversations.join(removed.select("conv_id", "user_id"), ["conv_id", "user_id"], "left_semi")
    return kept, messages.join(gone.select("conv_id"), "conv_id", "left_anti")


def owned(conversations: DataFrame, user_id: int) -> DataFrame:
    """One user's conversations; another's are as absent."""
    return conversations.filter(F.col("user_id") == user_id)
