"""Conversation transcripts, one JSON object a line, read tolerantly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "type string, isSidechain boolean, message struct<role:string,content:string>"
BLOCKS = "array<struct<type:string,text:string>>"


def turns(lines: DataFrame, keep: list[str], column: str = "value", place: str = "turn") -> DataFrame:
    """(keep, turn, role, text): the top-level turns of transcripts. Lines that aren't JSON and side chains are left out;
    content may be a string or a list of blocks, whose text blocks are joined."""
    rows = lines.select(*keep, place, F.from_json(F.trim(column), LINE).alias("e")).where("e is not null and not coalesce(e.isSidechain, false)")
    content = F.col("e.message.content")
    blocks = F.when(content.startswith("["), F.from_json(content, BLOCKS))
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    text = F.when(F.coalesce(joined, F.lit("")) != "", joined).when(~content.startswith("["), content).otherwise("")
    role = F.when((F.col("e.type") == "assistant") | (F.col("e.message.role") == "assistant"), "assistant").otherwise(F.coalesce("e.message.role", "e.type"))
    return rows.select(*keep, place, role.alias("role"), text.alias("text"))
