"""Read-only guard on generated SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException, ParseException

_WRITES = re.compile(r"\b(?:create|merge|delete|set|remove|drop|insert|update|call)\b", re.I)


def rejected(spark: SparkSession, query: str) -> str | None:
    """Why a query may not run, or None: it must parse, read only, and analyse against the views."""
    if m := _WRITES.search(query):
        return f"writes: {m[0]}"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
        if "Command" in plan.getClass().getSimpleName():
            return "is a command"
        spark.sql(query).schema
    except (ParseException, AnalysisException) as e:
        return str(e).strip().split("\n")[0] or type(e).__name__
    return None


def run_generated(spark: SparkSession, generate, attempts: int = 3) -> tuple[DataFrame | None, list[tuple[str, str | None]]]:
    """The first acceptable query's rows, and all attempts with their errors; generate(error) gives the next query."""
    log, error = [], None
    for _ in range(attempts):
        query = generate(error)
        error = rejected(spark, query)
        log.append((query, error))
        if error is None:
            return spark.sql(query), log
    return None, log
