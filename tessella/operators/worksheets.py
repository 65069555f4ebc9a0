"""Review worksheets: carrying human decisions over a rebuild, audits, adjudication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carry_locks(rows: DataFrame, locks: DataFrame) -> DataFrame:
    """Rows (slot, value, article, iri, status) with locked decisions put in; locks that meet no row are appended.

    A lock of the row's article goes before one of the value in general (null article).
    """
    own = locks.where("article is not null").select("slot", "value", "article", F.col("iri").alias("own_iri"), F.lit(True).alias("own"))
    general = locks.where("article is null").select("slot", "value", F.col("iri").alias("general_iri"), F.lit(True).alias("general"))
    out = rows.join(own, ["slot", "value", "article"], "left").join(general, ["slot", "value"], "left")
    locked = F.coalesce("own", F.lit(False)) | F.coalesce("general", F.lit(False))
    iri = F.when(F.col("own"), F.col("own_iri")).when(F.col("general"), F.col("general_iri")).otherwise(F.col("iri"))
    out = out.select("slot", "value", "article", iri.alias("iri"), F.when(locked, "manual").otherwise(F.col("status")).alias("status"))
    orphans = own.join(rows, ["slot", "value", "article"], "left_anti").select("slot", "value", "article", F.col("own_iri").alias("iri"))
    orphans = orphans.unionByName(general.join(rows, ["slot", "value"], "left_anti").select("slot", "value", F.lit(None).cast(rows.schema["article"].dataType).alias("article"), F.col("general_iri").alias("iri")))
    return out.unionByName(orphans.withColumn("status", F.lit("manual")))


def keep_human_fields(rebuilt: DataFrame, before: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The rebuilt rows with the human fields of their former ones, where any of these is set."""
    any_set = F.greatest(*(F.coalesce(F.trim(F.col(f)) != "", F.lit(False)) for f in fields)) if len(fields) > 1 else F.coalesce(F.trim(F.col(fields[0])) != "", F.lit(False))
    old = before.where(any_set).select(*key, *(F.col(f).alias(f"_{f}") for f in fields))
    out = rebuilt.join(old, key, "left")
    return out.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else c for c in rebuilt.columns))


def audit(resolved: DataFrame) -> DataFrame:
    """surface, regulation, status and n of resolved subjects; of several statuses of one subject the least."""
    return resolved.groupBy("surface", "regulation").agg(F.min("status").alias("status"), F.count("*").alias("n"))


def adjudicated(answers: DataFrame, allowed: DataFrame, least: float = 0.7) -> DataFrame:
    """Answers (id, slot, chosen, confidence) with their disposition.

    escalated where a choice isn't in the slot's vocabulary or confidence is under ``least``; literal where
    nothing is chosen; else mapped.
    """
    picked = answers.select("id", "slot", F.explode("chosen").alias("iri")).join(allowed.select("slot", "iri"), ["slot", "iri"], "left_anti").select("id").distinct().withColumn("invalid", F.lit(True))
    bad = F.coalesce("invalid", F.lit(False)) | (F.coalesce("confidence", F.lit(0.0)) < least)
    return answers.join(picked, "id", "left").withColumn("disposition", F.when(bad, "escalated").when(F.size("chosen") == 0, "literal").otherwise("mapped")).drop("invalid")
