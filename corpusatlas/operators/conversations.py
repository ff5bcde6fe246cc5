"""Conversation histories as flat ordered rows; no conversation is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.operators.ordered import numbered


def saved_messages(turns: DataFrame, **bounds) -> DataFrame:
    """Texts of all but system messages in order; roles are not kept."""
    chat = turns.where(F.col("role") != "system").select("conv_id", "turn", "text")
    placed = numbered(chat, ["conv_id"], ["turn"], "_n", **bounds)
    return placed.select("conv_id", (F.col("_n") - 1).alias("pos"), "text")


def system_messages(turns: DataFrame, given: str | None = None) -> DataFrame:
    """The given text, else the first system message, else null; one row each."""
    system = F.col("role") == "system"
    first = F.min_by(F.when(system, F.col("text")), F.when(system, F.col("turn")))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.nullif(F.lit(given).cast("string"), F.lit("")), first).alias("system_message")
    )


def loaded(messages: DataFrame, systems: DataFrame) -> DataFrame:
    """A history to go on with: the system message at -1, then user and assistant in turn."""
    role = F.when(F.col("pos") % 2 == 0, "user").otherwise("assistant")
    chat = messages.select("conv_id", "pos", role.alias("role"), "text")
    head = systems.where(F.length("system_message") > 0).select(
        "conv_id",
        F.lit(-1).cast("bigint").alias("pos"),
        F.lit("system").alias("role"),
        F.col("system_message").alias("text"),
    )
    return chat.unionByName(head)


def has_history(turns: DataFrame) -> DataFrame:
    """Whether a conversation holds a chat message or a system message with text."""
    system = F.col("role") == "system"
    found = ~system | (system & (F.length("text") > 0))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.bool_or(found), F.lit(False)).alias("has_history")
    )


def saved_file_has_history(saved: DataFrame, column: str = "value") -> DataFrame:
    """The same for saved JSON texts; a broken text has none."""
    parsed = F.try_parse_json(F.col(column))
    chat = F.try_variant_get(parsed, "$.chatMessages", "array<string>")
    system = F.try_variant_get(parsed, "$.systemMessage", "string")
    return saved.withColumn(
        "has_history",
        F.coalesce(F.size(chat) > 0, F.lit(False)) | F.coalesce(F.length(system) > 0, F.lit(False)),
    )
