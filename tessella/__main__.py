"""Thin command line: lists and runs registered queries, checks a stored graph, and tests itself.

    python -m tessella list
    python -m tessella run NAME TABLES --out PATH [--limit N]
    python -m tessella verify GRAPH --out PATH [--no-synthetic] [--no-holdout] [--reviewed PATH]
    python -m tessella selftest TABLES
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella import storage
from tessella.operators import verify
from tessella.plans import catalog


def _graph(spark: SparkSession, at: str) -> verify.Graph:
    return verify.Graph(*(spark.read.parquet(f"{at}/{name}") for name in verify.Graph._fields))


def check(spark: SparkSession, at: str, out: str, synthetic: bool = True, hold_out: bool = True, reviewed: str | None = None) -> None:
    """Writes verdicts, worksheet, edges, flags and dispositions of the graph stored at ``at``, a table for each field of Graph.

    Conflicts and equal definitions are written as sides and classes; pairs that meet in the predicate alone as predicate_sides.
    """
    g = _graph(spark, at)
    g = verify.inject(g, verify.synthetic_pair(spark)) if synthetic else verify.without_synthetic(g)
    facts = verify.facts_of(g)
    pairs = verify.contradictions(verify.polar_pairs(g, facts=facts)).withColumn("check", F.lit("contradiction"))
    same = verify.redundancies(g, facts).withColumnRenamed("modality", "a_modality").withColumn("check", F.lit("redundancy"))
    verdicts = storage.cut(pairs.unionByName(same, allowMissingColumns=True))
    sides = storage.cut(verify.conflict_sides(g, verify.patterns(spark)))
    terms = g.statements.where("statement_class = 'DEFINITIONAL' and term is not null")
    classes = storage.cut(verify.equal_terms(terms, F.lower("term"), "id"))
    labels = spark.read.json(reviewed, multiLine=True).select("check", "a", "b", F.col("human_label").alias("label")) if reviewed else None
    verdicts.write.mode("overwrite").parquet(f"{out}/verdicts")
    sides.write.mode("overwrite").parquet(f"{out}/conflict_sides")
    classes.write.mode("overwrite").parquet(f"{out}/definition_classes")
    verify.predicate_sides(g).write.mode("overwrite").parquet(f"{out}/predicate_sides")
    verify.worksheet(verdicts).write.mode("overwrite").parquet(f"{out}/worksheet")
    verify.verification_edges(verdicts, labels).write.mode("overwrite").parquet(f"{out}/edges")
    verify.flag_counts(verdicts, labels, sides, classes).write.mode("overwrite").parquet(f"{out}/flag_counts")
    verify.dispositions(g.statements, verdicts, labels, hold_out, sides, classes).write.mode("overwrite").parquet(f"{out}/dispositions")


def selftest(spark: SparkSession, tables: str) -> None:
    """Fails where the statement graph is empty, a query over it cannot be planned, or a tension is not found."""
    found = catalog.QUERIES["graph_counts"](spark, tables).collect()
    assert {r.kind for r in found if r.n > 0} >= {"statements", "concepts", "provisions", "broader"}, found
    for name in ("seeds_by_prefix", "expanded_nodes", "answer_contexts"):
        catalog.QUERIES[name](spark, tables).explain("simple")
    assert catalog.QUERIES["contradiction_pairs"](spark, tables).where("verdict <> 'none'").limit(1).count()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessella")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("tables")
    run.add_argument("--out", required=True)
    run.add_argument("--limit", type=int)
    one = commands.add_parser("verify")
    one.add_argument("graph")
    one.add_argument("--out", required=True)
    one.add_argument("--no-synthetic", action="store_true")
    one.add_argument("--no-holdout", action="store_true")
    one.add_argument("--reviewed")
    commands.add_parser("selftest").add_argument("tables")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if args.command == "run":
        out = catalog.QUERIES[args.name](spark, args.tables)
        (out if args.limit is None else out.limit(args.limit)).write.mode("overwrite").parquet(args.out)
    elif args.command == "verify":
        check(spark, args.graph, args.out, not args.no_synthetic, not args.no_holdout, args.reviewed)
    else:
        selftest(spark, args.tables)


if __name__ == "__main__":
    main()
