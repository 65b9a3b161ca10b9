"""Conversation filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def role_messages(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """One role's messages; ``conv_id, turn`` give their order."""
    return conversations.where(F.col("role") == role).select("conv_id", "turn", "text")


def first_message_with(conversations: DataFrame, phrase: str) -> DataFrame:
    """First message of each conversation that holds the phrase."""
    hits = conversations.where(F.contains("text", F.lit(phrase)))
    return hits.groupBy("conv_id").agg(
        F.min("turn").alias("turn"), F.min_by("text", "turn").alias("text")
    )
