"""The stop gate: does the last assistant turn of a conversation keep the hard invariants?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import trimmed

from .lint import hard_counts


def last_assistant(turns: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, text) of each conversation's last assistant turn that has text. A maximum by turn, combined
    before the shuffle: a conversation of any length is one row a task."""
    said = turns.where((F.col(role) == "assistant") & (F.coalesce(F.col(text), F.lit("")) != ""))
    last = said.groupBy(conversation).agg(F.max(F.struct(F.col(turn).alias("turn"), F.col(text).alias("text"))).alias("l"))
    return last.select(conversation, F.col("l.turn").alias("turn"), F.col("l.text").alias("text"))


def decisions(last: DataFrame, conversation: str, avoided: list[str], text: str = "text") -> DataFrame:
    """(conversation, decision, n_hard): block where an avoided term occurs, else allow. Nothing to avoid: always allow."""
    n = F.when(trimmed(F.col(text)) != "", hard_counts(last, avoided, text)).otherwise(F.lit(0).cast("bigint"))
    return last.select(conversation, n.alias("n_hard")).select(conversation, F.when(F.col("n_hard") > 0, "block").otherwise("allow").alias("decision"), "n_hard")


def reason(terms: Column) -> Column:
    """The message of a block, from an array of (term, start)."""
    listed = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("'"), t["term"], F.lit("' at byte "), t["start"].cast("string"))), ", ")
    return F.concat(F.lit("The response breaks hard invariants of the target style. Avoided terms: "), listed, F.lit(". Rewrite it without them."))
