"""Graph tables: hierarchy closure, roots, neighbourhoods, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import storage


def closure(edges: DataFrame) -> DataFrame:
    """child and ancestor over zero or more steps of (child, parent), without a bound; cycles end by themselves.

    Each round joins the pairs found so far with themselves, which doubles the steps they span, and drops repeated
    ones, so that a lattice costs its pairs, not its paths; it is over when a round finds nothing new.
    """
    steps = edges.select("child", F.col("parent").alias("ancestor")).where("child is not null and parent is not null")
    nodes = steps.select("child").union(steps.select("ancestor")).distinct()
    pairs = storage.cut(steps.union(nodes.select("child", F.col("child").alias("ancestor"))).distinct())
    known = pairs.count()
    while True:
        on = pairs.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("further"))
        pairs = storage.cut(pairs.join(on, "ancestor").select("child", F.col("further").alias("ancestor")).distinct())
        now = pairs.count()
        if now == known:
            return pairs
        known = now


def roots(edges: DataFrame, order: str = "parent") -> DataFrame:
    """The topmost ancestor and its distance for each child, along the first parent by ``order``; a cycle ends before it would close.

    As in closure each round doubles the steps; a child in a cycle ends at the node from which the next step
    would meet one it has been at.
    """
    first = edges.where("child is not null and parent is not null").groupBy("child").agg(F.min_by("parent", order).alias("parent"))
    at = first.select("child", F.col("parent").alias("root"), F.array("child", "parent").alias("path"))
    at = storage.cut(at.where("child <> parent").union(at.where("child = parent").select("child", "child", F.array("child"))))
    while True:
        on = at.select(F.col("child").alias("root"), F.col("path").alias("on"))
        joined = at.join(on, "root", "left")
        # what lies behind the root, up to the first node that has been visited
        more = F.slice(F.coalesce("on", F.array("root")), 2, F.greatest(F.size(F.coalesce("on", F.array("root"))) - 1, F.lit(0)))
        free = F.aggregate(more, F.struct(F.col("path").alias("path"), F.lit(True).alias("goes")), lambda s, x: F.struct(F.when(s["goes"] & ~F.array_contains(s["path"], x), F.concat(s["path"], F.array(x))).otherwise(s["path"]).alias("path"), (s["goes"] & ~F.array_contains(s["path"], x)).alias("goes")))["path"]
        step = storage.cut(joined.select("child", "path", free.alias("grown")))
        if not step.where(F.size("grown") > F.size("path")).limit(1).count():
            return step.select("child", F.element_at("path", -1).alias("root"), (F.size("path") - 1).alias("depth"))
        at = step.select("child", F.element_at("grown", -1).alias("root"), F.col("grown").alias("path"))


def parents_of_used(edges: DataFrame, used: DataFrame) -> DataFrame:
    """The direct (child, parent) pairs that are met going up from the used concepts (iri)."""
    up = closure(edges)
    met = up.join(used.select(F.col("iri").alias("child")).distinct(), "child", "left_semi").select(F.col("ancestor").alias("child")).distinct()
    return edges.select("child", "parent").distinct().join(met, "child", "left_semi")


def expand(seeds: DataFrame, edges: DataFrame, kept: DataFrame | None = None, relations: tuple[str, ...] | None = None) -> DataFrame:
    """Seeds and their neighbours over undirected edges (src, dst), of the relations (rel) and with both ends among ``kept`` where given."""
    if relations is not None:
        edges = edges.where(F.col("rel").isin(*relations))
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = seeds.select("id") if kept is None else seeds.select("id").join(kept.select("id"), "id", "left_semi")
    out = both.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).union(seeds).distinct()
    return out if kept is None else out.join(kept.select("id"), "id", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with both ends among the nodes."""
    out = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return out.distinct()


def prefix_any(iri: Column, prefixes: list[str], bounded: bool = False) -> Column:
    """Whether an identifier starts with any prefix: as a raw string, or ended by a slash or the end."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (((iri == p) | iri.startswith(f"{p}/") | iri.startswith(f"{p}#")) if bounded else iri.startswith(p))
    return out


def under_prefixes(items: DataFrame, column: str, prefixes: DataFrame, bounded: bool = False) -> DataFrame:
    """The distinct values of the column with each prefix (a column of prefixes) that they start with; ``bounded`` as for :func:`prefix_any`.

    Each value is cut at the lengths that prefixes have and joined on equality, so that no key holds more than its true
    matches. The lengths, at most as many as the longest prefix has characters, are all that is sent to every task.
    """
    wanted = prefixes.select("prefix").where("prefix is not null").distinct()
    lengths = wanted.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cuts = items.select(column).where(F.col(column).isNotNull()).distinct().crossJoin(F.broadcast(lengths))
    cuts = cuts.select(column, F.explode(F.filter("lengths", lambda n: n <= F.length(column))).alias("n"))
    cuts = cuts.select(column, F.substr(column, F.lit(1), F.col("n")).alias("prefix"), F.substr(column, F.col("n") + 1, F.lit(1)).alias("next"))
    return (cuts.where(F.col("next").isin("", "/", "#")) if bounded else cuts).join(wanted, "prefix").select(column, "prefix")


def last_by_key(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row per key, the one with the largest sequence: an idempotent upsert of later rows over earlier ones.

    Rows of one sequence are told apart by their other values, so that the result doesn't depend on their order.
    """
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(sequence, *(c for c in others if c != sequence))).alias("row"))
    return top.select(*keys, *(F.col(f"row.{c}").alias(c) for c in others))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows put in: new keys are added, and of known ones those values that the rows have replace what was there."""
    new = rows.select(*keys, *(F.col(c).alias(f"new_{c}") for c in rows.columns if c not in keys))
    out = table.join(new, keys, "full")
    every = [*table.columns, *(c for c in rows.columns if c not in table.columns)]
    value = lambda c: c if c in keys else F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in rows.columns and c in table.columns else F.col(f"new_{c}").alias(c) if c in rows.columns else c
    return out.select(*(value(c) for c in every))


def without(table: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    """The table without the rows whose id, or one of whose ends, is among the nodes (id); what stays is a new table."""
    for end in ends or ("id",):
        table = table.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_anti").select(*table.columns)
    return table


def graph_counts(statements: DataFrame, slots: DataFrame, sources: DataFrame, broader: DataFrame) -> DataFrame:
    """kind and n of statements (synthetic ones apart), concepts, provisions and hierarchy edges."""
    one = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    synthetic = F.coalesce(F.col("synthetic"), F.lit(False)) if "synthetic" in statements.columns else F.lit(False)
    parts = [one("statements", statements.where(~synthetic)), one("synthetic", statements.where(synthetic)), one("concepts", slots.select("iri").where("iri is not null").distinct()), one("provisions", sources.select("provision").distinct()), one("broader", broader.distinct())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def slot_edges(statements: DataFrame, slots: dict[str, str]) -> DataFrame:
    """statement_id, rel, value, iri, method and mapping_status, one row per slot element and concept.

    Slots are arrays of struct(value, method, iri array, mapping_status); a scalar is an array of one.
    """
    out = None
    for slot, rel in slots.items():
        e = statements.select("statement_id", F.explode(slot).alias("e")).select("statement_id", F.lit(rel).alias("rel"), F.col("e.value").alias("value"), F.explode_outer("e.iri").alias("iri"), F.col("e.method").alias("method"), F.col("e.mapping_status").alias("mapping_status"))
        out = e if out is None else out.unionByName(e)
    return out


def statement_nodes(statements: DataFrame, slots: dict[str, str], flags: tuple[str, ...]) -> DataFrame:
    """One row per statement that applies: its id, class, modality, paragraph, text of each slot, flags that are set, and review labels.

    A statement counts as suggested by a model where a slot element's mapping_status says so, and as reviewed where one
    was set manually.
    """
    applies = statements.where("statement_class <> 'NOT_APPLICABLE'")
    status = F.flatten(F.array(*(F.coalesce(F.transform(F.col(s), lambda e: e["mapping_status"]), F.array().cast("array<string>")) for s in slots)))
    named = F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(F.col(f).cast("boolean"), F.lit(False)), F.lit(f)) for f in flags)))) if flags else F.array().cast("array<string>")
    texts = [F.transform(F.coalesce(F.col(s), F.array().cast(applies.schema[s].dataType)), lambda e: e["value"]).alias(f"{s}_text") for s in slots]
    return applies.select("statement_id", "statement_class", "modality", "paragraph_iri", *texts, named.alias("flags"), F.coalesce(F.exists(status, lambda s: s.startswith("llm_suggested")), F.lit(False)).alias("is_llm_suggested"), F.coalesce(F.exists(status, lambda s: s.startswith("manually")), F.lit(False)).alias("is_human_reviewed"))


def reference_edges(statements: DataFrame) -> DataFrame:
    """src, dst and kind of each reference: to a statement where it names one by '#', else to a provision."""
    out = statements.where("statement_class <> 'NOT_APPLICABLE'").select(F.col("statement_id").alias("src"), F.explode("references").alias("dst")).distinct()
    return out.withColumn("kind", F.when(F.contains("dst", F.lit("#")), "statement").otherwise("provision"))
