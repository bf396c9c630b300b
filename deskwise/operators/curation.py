"""Row filters, message pairing and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskwise.functions import text as tx
from deskwise.functions.columns import col, compute_once
from deskwise.session import broadcast_if_small

ROW = "__row"
STRETCH = 1 << 16  # turn numbers of a conversation in one window


def pair_turns(
    turns: DataFrame,
    inbound: str = "user",
    outbound: str = "assistant",
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Customer message and the reply that directly follows it, whatever turn numbers are left out.

    Turn numbers are unique inside a conversation. Each stretch of ``STRETCH`` numbers is one window, so that
    a conversation holding a third of all rows still spreads over every partition; the last message of a
    stretch meets the first one of the conversation's next stretch. Texts are shuffled once: which messages are first is
    found on the keys alone, and they are few, since most conversations have one stretch only.
    """
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = turns.select(F.col(conv), F.floor(F.col(turn) / STRETCH).alias("__stretch"), message.alias("__m"))
    inside = Window.partitionBy(conv, "__stretch").orderBy("__m.turn")
    across = Window.partitionBy(conv).orderBy("__stretch")
    starts = rows.groupBy(conv, "__stretch").agg(F.min("__m.turn").alias("__turn"))
    starts = starts.withColumn("__before", F.lag("__stretch").over(across)).where("__before IS NOT NULL")
    starts = starts.select(F.col(conv).alias("__conv"), F.col("__turn"), "__before")
    first = (F.col(conv) == F.col("__conv")) & (F.col("__m.turn") == F.col("__turn"))
    heads = rows.join(broadcast_if_small(starts), first).select(conv, F.col("__before").alias("__stretch"), F.col("__m").alias("__head"))
    asked = rows.withColumn("__next", F.lead("__m").over(inside)).where(F.col("__m.role") == inbound)
    reply = F.coalesce("__next", "__head")
    pairs = asked.join(heads, [conv, "__stretch"], "left").withColumn("__reply", reply)
    return pairs.where(F.col("__reply.role") == outbound).select(
        F.col(conv),
        F.col("__m.turn").alias(turn),
        F.concat_ws("-", conv, "__m.turn").alias("message_id"),
        F.col("__m.text").alias("customer_message"),
        F.concat_ws("-", conv, "__reply.turn").alias("response_id"),
        F.col("__reply.text").alias("agent_response"),
    )


def pair_replies(
    messages: DataFrame,
    key: str = "message_id",
    reply_to: str = "in_reply_to",
    inbound: str = "inbound",
    text: str = "text",
) -> DataFrame:
    """The same from raw messages that name the message they answer: an equi-join on unique ids.

    A message answered several times gives one pair per answer.
    """
    asked = messages.where(F.col(inbound)).select(
        F.col(key).alias("message_id"), F.col(text).alias("customer_message")
    )
    answered = messages.where(~F.col(inbound)).select(
        F.col(reply_to).alias("message_id"), F.col(key).alias("response_id"), F.col(text).alias("agent_response")
    )
    return asked.join(answered, "message_id")


def non_empty(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c) != "")
    return df


def min_length(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    for c in columns:
        df = df.where(F.length(c) >= n)
    return df


def drop_acknowledgements(df: DataFrame, column: str) -> DataFrame:
    return df.where(~tx.is_acknowledgement(column))


def keep_language(
    df: DataFrame, columns: Sequence[str], lang: str = "en", threshold: float = 0.80
) -> DataFrame:
    """Rows whose every column is in ``lang`` by the share of function words."""
    for c in columns:
        df = df.where(tx.language_share(c, lang) >= threshold)
    return df


def clean_columns(df: DataFrame, columns: Sequence[str], profile: str) -> DataFrame:
    """Cleaned texts in place, computed once whatever filters follow."""
    return compute_once(df, {c: tx.clean_text(c, profile) for c in columns})


def first_rows(
    df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], n: int = 1
) -> DataFrame:
    """The first ``n`` rows of every key by an explicit order; nulls form one key.

    Spark limits each key inside every map task before the shuffle (``WindowGroupLimit``), so
    a key that holds a third of the rows sends at most ``n`` of them per task. The 64-bit hash leads
    the sort, which compares eight bytes where keys are long texts.
    """
    cols = [col(k) for k in keys]
    window = Window.partitionBy(F.xxhash64(*cols), *cols).orderBy(*[col(o) for o in order])
    return df.withColumn(ROW, F.row_number().over(window)).where(F.col(ROW) <= n).drop(ROW)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return first_rows(df, keys, order, 1)


def union_by_priority(*parts: DataFrame, priority: str = "priority") -> DataFrame:
    """Union whose ``priority`` column ranks the inputs, first input first."""
    tagged = [p.withColumn(priority, F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out


def dedupe_chain(
    df: DataFrame, key_lists: Sequence[Sequence[str]], order: Sequence[Column | str]
) -> DataFrame:
    """Keep-first passes one after the other; the sequence matters."""
    for keys in key_lists:
        df = dedupe_first(df, keys, order)
    return df


def duplicate_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first per value, one output row per column; nulls count as one value.

    One scan: every row gives one digest per column, and digests are counted first (map-side combined), so no
    distinct set is ever gathered and no text is shuffled.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), tx.digest(c).alias("k")) for i, c in enumerate(columns)])
    per_value = df.select(F.explode(cells).alias("v")).groupBy("v.i", "v.k").agg(F.count(F.lit(1)).alias("n"))
    n = [F.when(F.col("i") == i, F.col("n")) for i in range(len(columns))]
    zero = F.lit(0).cast("long")
    totals = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(F.sum(n[i]), zero).alias("n_rows"),
            F.coalesce(F.sum(n[i] - 1), zero).alias("n_duplicates"),
        )
        for i, c in enumerate(columns)
    ]
    return per_value.agg(F.array(*totals).alias("t")).select(F.inline("t"))


def blank_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("string") for c in columns})
