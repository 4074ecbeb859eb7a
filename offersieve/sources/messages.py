"""Offers from chat messages, and the table of chats they may come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.functions import text as X


def offers(messages: DataFrame, chat: str, number: str, text: str) -> DataFrame:
    """id, title, text, urls, price: the title is the first line that is not blank, the text is whole, URLs are distinct
    and in order, and the price is the stated one. A null text has no title, URL or price."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    urls = F.transform(F.regexp_extract_all(t, F.lit(r"https?://\S+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,);\]]+$", ""))
    return messages.select(F.concat_ws(":", F.col(chat).cast("string"), F.col(number).cast("string")).alias("id"), F.get(lines, F.lit(0)).alias("title"), t.alias("text"), F.array_distinct(urls).alias("urls"), X.stated_price(t).alias("price"))


def allowed(offer_rows: DataFrame, chats: DataFrame, chat: str = "chat_id") -> DataFrame:
    """Offers of enabled chats. Which side is small enough to broadcast is left to the planner's size estimate."""
    return offer_rows.join(chats.filter("enabled").select(chat), chat, "left_semi")


def upsert(table: DataFrame, found: DataFrame, key: str, columns: list[str], keep: str = "enabled") -> DataFrame:
    """The table after a discovery: found rows bring their columns, `keep` stays as it was, and is false for new rows."""
    a, b = table.select(key, *columns, keep), found.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("seen"))
    j = a.join(b, key, "full_outer")
    cols = [F.when(F.col("seen"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return j.select(key, *cols, F.coalesce(keep, F.lit(False)).alias(keep))


def seeded(table: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """The table with the seed rows whose key it lacks."""
    return table.unionByName(seed.select(table.columns).dropDuplicates([key]).join(table.select(key), key, "left_anti"))
