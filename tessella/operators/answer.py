"""Answering questions over the verified graph: covered provisions, seeds, expansion, contexts and verdicts.

Questions are a table and are worked on together: each step is a join on query_id. Language models sit behind
operators/models.py; what they return is JSON, read with a schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import graph, models, retrieve

#: Seeds of a question, provisions that seed densely and how many more are looked at, and for the last resort, and those shown to a model.
MOST_SEEDS, DENSE, WIDER, FALLBACK, NARROW = 100, 8, 3, 3, 50
EXPANDS = ("REFERS_TO", "EXCEPTION_OF", "CONFLICTS_WITH")
SHOWN = (*EXPANDS, "SPECIALISES", "REDUNDANT_WITH")
INTENT = "mode string, target_provisions array<string>, scenario_facts array<string>, rationale string"
VERDICT = "verdict string, explanation string, cited array<string>, missing_information string"
LABELS = ("COMPLIANT", "NON_COMPLIANT", "INSUFFICIENT", "NOT_APPLICABLE")


def verified(statements: DataFrame, **wanted: str) -> DataFrame:
    """The verified statements, of the properties wanted."""
    out = statements.where("verified")
    for k, v in wanted.items():
        out = out.where(F.col(k) == v)
    return out


def covered(statements: DataFrame, sources: DataFrame, provisions: DataFrame) -> DataFrame:
    """provision and text of the provisions that verified statements come from."""
    used = verified(statements).select("id").join(sources, "id").select("provision").distinct()
    return used.join(provisions, "provision", "left").select("provision", "text")


def nearest(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, provision, score and rank of the k nearest provisions. questions: query_id and q; vectors: provision and embedding, both of length one."""
    named = vectors.select(F.col("provision").alias("vec_id"), "embedding")
    out = retrieve.top_k(questions.select("query_id", "q"), named, k, cosines=False)
    return out.withColumnRenamed("vec_id", "provision")


def shown_provisions(questions: DataFrame, vectors: DataFrame, most: int = NARROW) -> DataFrame:
    """query_id and provision that a model is shown: all that are covered, or the ``most`` nearest ones where there are more."""
    if vectors.limit(most + 1).count() <= most:
        return questions.select("query_id").join(F.broadcast(vectors.select("provision")), F.lit(True))
    return nearest(questions, vectors, most).select("query_id", "provision")


def dense_provisions(questions: DataFrame, vectors: DataFrame, k: int = DENSE, wider: int = WIDER) -> DataFrame:
    """query_id, provision and rank of the k nearest provisions that are no recitals, among the first k * wider of all."""
    found = nearest(questions, vectors, k * wider).where(~F.contains("provision", F.lit("rct_")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "provision", F.col("place").alias("rank"))


def seeds_below(statements: DataFrame, sources: DataFrame, prefixes: DataFrame, bounded: bool = False, most: int = MOST_SEEDS) -> DataFrame:
    """query_id and id of the first ``most`` verified statements whose provision starts with one of the question's prefixes (query_id, prefix).

    A prefix is raw, so that art_5 also meets art_50; ``bounded`` ends it at a slash, a hash or the end.
    """
    named = verified(statements).select("id").join(sources, "id")
    met = graph.under_prefixes(named.select("provision"), "provision", prefixes, bounded).join(prefixes.distinct(), "prefix").select("query_id", "provision").distinct()
    return first_seeds(met.join(named, "provision").select("query_id", "id"), most)


def first_seeds(seeds: DataFrame, most: int = MOST_SEEDS) -> DataFrame:
    """The first ``most`` seeds of each question in the order of their ids."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return seeds.distinct().withColumn("place", place).where(F.col("place") <= most).drop("place")


def choose_seeds(intents: DataFrame, statements: DataFrame, sources: DataFrame, questions: DataFrame, vectors: DataFrame, generated: DataFrame | None = None, dense: bool = False, bounded: bool = False) -> DataFrame:
    """query_id, seed_path and id: seeds by the first way that gives a question any.

    The ways are the provisions that its intent names, a generated query's rows (query_id, id), and the nearest provisions; or
    with ``dense`` the nearest provisions alone, recitals left out. intents: query_id and target_provisions, which are raw prefixes or
    with ``bounded`` end as for :func:`seeds_below`: a provision that isn't there then gives no seeds, and the next way is taken.
    """
    below = lambda df: seeds_below(statements, sources, df.select("query_id", F.col("provision").alias("prefix")))
    if dense:
        return below(dense_provisions(questions, vectors)).withColumn("seed_path", F.lit("dense_retrieval")).select("query_id", "seed_path", "id")
    ways = [("template", seeds_below(statements, sources, intents.select("query_id", F.explode("target_provisions").alias("prefix")).distinct(), bounded))]
    if generated is not None:
        ways.append(("llm_query", first_seeds(generated.select("query_id", "id"))))
    ways.append(("vector_fallback", below(nearest(questions, vectors, FALLBACK))))
    out = None
    for name, found in ways:
        found = found.withColumn("seed_path", F.lit(name)).select("query_id", "seed_path", "id")
        out = found if out is None else out.unionByName(found.join(out.select("query_id").distinct(), "query_id", "left_anti").select(*found.columns))
    return out


def expanded(seeds: DataFrame, edges: DataFrame, statements: DataFrame) -> DataFrame:
    """query_id and id of the seeds and their neighbours over the relations that expand, all verified."""
    kept = verified(statements).select("id")
    step = edges.where(F.col("rel").isin(*EXPANDS))
    both = step.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(step.select(F.col("dst").alias("id"), F.col("src").alias("to")))
    start = seeds.select("query_id", "id").distinct().join(kept, "id", "left_semi").select("query_id", "id")
    near = start.join(both, "id").select("query_id", F.col("to").alias("id")).join(kept, "id", "left_semi").select("query_id", "id")
    return start.union(near).distinct()


def edges_among(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, src, rel and dst of the edges both of whose ends are among a question's statements."""
    step = edges.where(F.col("rel").isin(*SHOWN)).select("src", "rel", "dst").distinct()
    first = step.join(nodes.withColumnRenamed("id", "src"), "src")
    return first.join(nodes.select(F.col("query_id"), F.col("id").alias("dst")), ["query_id", "dst"]).select("query_id", "src", "rel", "dst")


def rendered(row: DataFrame) -> Column:
    """A statement as a block of a prompt: id, class, source, what its class says, the lead-ins above it, and its own text.

    The text is the anchor, or else the paragraph. Columns: id, statement_class, source_article, modality, term, definition, scope_type,
    polarity, applies_to, parent_texts, anchor and paragraph_text.
    """
    c, said = F.col("statement_class"), lambda x: F.coalesce(F.col(x), F.lit("None"))
    line = F.when(c == "DEONTIC", F.concat(F.lit("  modality: "), said("modality"))).when(c == "DEFINITIONAL", F.concat(F.lit("  defines '"), said("term"), F.lit("' as: "), said("definition"))).when(c == "APPLICABILITY", F.concat(F.lit("  scope: "), said("scope_type"), F.lit(" polarity="), said("polarity"), F.lit(" applies_to: "), said("applies_to")))
    above = F.filter(F.coalesce("parent_texts", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    context = F.when(F.size(above) > 0, F.concat(F.lit('  context: "'), F.array_join(above, " "), F.lit('"')))
    text = F.coalesce(F.nullif("anchor", F.lit("")), F.nullif("paragraph_text", F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("["), "id", F.lit("] "), c), F.concat(F.lit("  source: "), said("source_article")), line, context, F.when(text.isNotNull(), F.concat(F.lit('  text: "'), text, F.lit('"'))))


def contexts(nodes: DataFrame, statements: DataFrame, edges: DataFrame, snippets: DataFrame) -> DataFrame:
    """query_id with the texts of its statements, edges and snippets (query_id, provision, text, rank), each in a fixed order; '(none)' where there are none."""

    def joined(df: DataFrame, order: list[str], line: Column, between: str, name: str) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
        return df.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), between).alias(name))

    blocks = nodes.join(statements.withColumn("block", rendered(statements)).select("id", "block"), "id")
    parts = [joined(blocks, ["id"], F.col("block"), "\n\n", "statements"), joined(edges_among(nodes, edges), ["src", "rel", "dst"], F.concat_ws(" ", "src", "rel", "dst"), "\n", "edges"), joined(snippets, ["rank"], F.concat(F.lit("["), "provision", F.lit("] "), F.coalesce("text", F.lit(""))), "\n\n", "snippets")]
    out = nodes.select("query_id").union(snippets.select("query_id")).distinct()
    for p in parts:
        out = out.join(p, "query_id", "left")
    return out.select("query_id", *(F.coalesce(c, F.lit("(none)")).alias(c) for c in ("statements", "edges", "snippets")))


def structured(rows: DataFrame, model: models.Model, prompt: Column, schema: str, name: str) -> DataFrame:
    """The rows with the model's answer to the prompt, read by the schema, as ``name``; null where it failed, and why in ``name``_error."""
    asked = models.ask(rows.withColumn("prompt", prompt), model).drop("prompt")
    return asked.withColumn(name, models.parsed(F.col("answer"), schema)).withColumn(f"{name}_error", F.coalesce("error", F.when(F.col(name).isNull(), "the answer is not of the schema"))).drop("answer", "error")


def classify(questions: DataFrame, shown: DataFrame, model: models.Model) -> DataFrame:
    """The questions (query_id, question) with their intent, told from the provisions shown."""
    lists = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("provision")), lambda p: F.concat(F.lit("- "), p)), "\n").alias("covered"))
    prompt = F.concat_ws("\n", F.lit("Question:"), "question", F.lit("Covered provisions:"), F.coalesce("covered", F.lit("")))
    return structured(questions.join(lists, "query_id", "left"), model, prompt, INTENT, "intent").drop("covered")


def synthesise(rows: DataFrame, model: models.Model) -> DataFrame:
    """The rows (query_id, question, statements, edges, snippets) with a verdict; an unknown label counts as no answer."""
    prompt = F.concat_ws("\n", F.lit("Question:"), "question", F.lit("Statements:"), "statements", F.lit("Edges:"), "edges", F.lit("Snippets:"), "snippets")
    out = structured(rows, model, prompt, VERDICT, "verdict")
    return out.withColumn("verdict", F.when(F.col("verdict.verdict").isin(*LABELS), F.col("verdict")))


def baseline(questions: DataFrame, snippets: DataFrame, model: models.Model) -> DataFrame:
    """Verdicts from snippets alone, without the graph."""
    none = F.lit("(none)")
    text = snippets.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "provision", F.lit("] "), F.coalesce("text", F.lit(""))).alias("line")))), lambda x: x["line"]), "\n\n").alias("snippets"))
    rows = questions.join(text, "query_id", "left").withColumns({"snippets": F.coalesce("snippets", none), "statements": none, "edges": none})
    return synthesise(rows, model).withColumn("seed_path", F.lit("baseline_rag"))


def model_only(questions: DataFrame, model: models.Model) -> DataFrame:
    """Verdicts from the question alone."""
    return structured(questions, model, F.col("question"), VERDICT, "verdict").withColumn("seed_path", F.lit("llm_only"))


def to_review(results: DataFrame) -> DataFrame:
    """The results whose verdict is that too little is known, for the review queue."""
    return results.where(F.col("verdict.verdict") == "INSUFFICIENT")


def index_version(model: Column, entries: DataFrame) -> DataFrame:
    """version: a digest of the model's name and all entries (provision, text), by which stored vectors are known to be theirs."""
    each = entries.select(F.sha2(F.concat_ws("\u001f", F.coalesce("provision", F.lit("")), F.coalesce("text", F.lit(""))), 256).alias("h"))
    # an order-free digest of any number of entries: sums of parts of their digests
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)"))
    sums = each.agg(F.count("*").alias("n"), *(part(k).alias(f"p{k}") for k in range(8)))
    return sums.select(F.sha2(F.concat_ws("|", model, "n", *(F.coalesce(F.col(f"p{k}").cast("string"), F.lit("0")) for k in range(8))), 256).alias("version"))
