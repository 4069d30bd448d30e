"""Chat history windows and log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.functions import text as tx


def recent_messages(messages: DataFrame, session: str = "session_id", turn: str = "turn", n: int = domain.CHAT_WINDOW) -> DataFrame:
    """Last ``n`` messages of each session, without the final one where there
    are more than one. Roles become ``user`` or ``model``.

    Both limits are on ``row_number``, so each partition keeps n rows per
    session before the shuffle, however long a session is.
    """
    newest = Window.partitionBy(session).orderBy(F.desc(turn))
    last = messages.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)
    size = F.count("*").over(Window.partitionBy(session))
    return (
        last.withColumn("_size", size)
        .filter("_size > 1 and _back > 1")
        .withColumn("role", F.when(F.col("role") == "user", "user").otherwise("model"))
        .drop("_back", "_size")
    )


def prompts(requests: DataFrame, history: DataFrame, session: str = "session_id", turn: str = "turn", message: str = "message") -> DataFrame:
    """Each request with its context prefix and the window of earlier messages.

    ``requests`` has ``message`` and the nullable columns ``fault_category``
    and ``confidence`` of the event under discussion, with ``has_context``.
    """
    entries = F.array_sort(F.collect_list(F.struct(turn, "role", F.col(message).alias("content"))))
    window = history.groupBy(session).agg(
        F.transform(entries, lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content"))).alias("history")
    )
    none = F.lit("None")
    prefix = tx.fill(
        domain.CHAT_CONTEXT,
        fault_category=F.coalesce("fault_category", none),
        confidence=F.coalesce(F.col("confidence").cast("string"), none),
    )
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return requests.join(window, session, "left").select(
        session,
        F.concat(F.when(F.col("has_context"), prefix).otherwise(F.lit("")), F.col(message)).alias("prompt"),
        F.coalesce("history", empty).alias("history"),
    )


def log_rows(turns: DataFrame, session: str = "session_id", context: str = "event_context") -> DataFrame:
    """Two log rows, user and assistant, per answered request."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("message").alias("message")),
        F.struct(F.lit("assistant").alias("role"), F.col("response").alias("message")),
    )
    return turns.select(F.col(session).alias("session_id"), F.explode(pair).alias("m"), F.col(context).alias("event_context")).select(
        "session_id", "m.role", "m.message", "event_context", F.current_timestamp().alias("timestamp")
    )
