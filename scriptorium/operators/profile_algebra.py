"""Set operations on profile tables: inheritance and merging of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(child: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """Union by key in which the base's row replaces the child's, in the child's place; rows that only the base has come
    after. Both have ``pos``."""
    columns = [c for c in child.columns if c not in (key, "pos")]
    both = child.select(key, "pos", F.lit(True).alias("own")).join(base.select(key, F.col("pos").alias("base_pos"), *columns, F.lit(True).alias("based")), key, "full")
    both = both.join(child.select(key, *[F.col(c).alias(f"child_{c}") for c in columns]), key, "left")
    picked = [F.when(F.col("based"), F.col(c)).otherwise(F.col(f"child_{c}")).alias(c) for c in columns]
    place = F.coalesce(F.col("pos"), F.lit(1 << 30) + F.col("base_pos"))
    return both.select(key, place.alias("pos"), *picked, F.when(F.col("based"), "base").otherwise("child").alias("source"))


def union_terms(child: Column, base: Column) -> Column:
    """Ordered union of two term lists, the child's first, without empty terms and repeats."""
    return F.array_distinct(F.filter(F.concat(child, base), lambda t: t != ""))


def add_rules(rules: DataFrame, more: DataFrame, key: str = "rule_id") -> tuple[DataFrame, DataFrame]:
    """(all rules with the fresh ones of ``more``, those skipped because their id exists)."""
    return rules.unionByName(more.join(rules, key, "left_anti"), allowMissingColumns=True), more.join(rules, key, "left_semi")


def resolve(listing: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, id): each name's profile by file stem, else by id or register, the first by path. ``listing`` has path, stem,
    id, register; it is a directory's worth of rows."""
    by_stem = refs.join(F.broadcast(listing), F.col("ref") == F.col("stem")).select("ref", F.lit(0).alias("how"), "path", "id")
    by_name = refs.join(F.broadcast(listing.select("path", "id", "register", F.explode(F.array_distinct(F.array("id", "register"))).alias("name"))), F.col("ref") == F.col("name"))
    every = by_stem.unionByName(by_name.select("ref", F.lit(1).alias("how"), "path", "id"))
    found = every.groupBy("ref").agg(F.min(F.struct("how", "path", "id")).alias("f"))
    return refs.select("ref").distinct().join(found, "ref", "left").select("ref", F.col("f.id").alias("id"))
