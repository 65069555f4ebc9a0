"""What is asked of language models about paragraphs: screening, extraction, adjudication, and reading back.

Prompts are columns, answers are JSON that a schema reads, and an error never drops a row. Models are those of
operators/models.py; a replay of stored answers serves tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import models, passes

SCREEN = "keep boolean, justification string"
CANDIDATES = "candidates array<struct<statement_class:string,anchor:string,rationale:string>>"
ELEMENT = "struct<value:string,method:string>"
STATEMENT = f"modality string, subject array<{ELEMENT}>, predicate array<{ELEMENT}>, object array<{ELEMENT}>, condition {ELEMENT}, beneficiary {ELEMENT}, term string, definition {ELEMENT}, scope_type string, applies_to {ELEMENT}, polarity string, references array<string>, confidence double, applies_to_healthcare boolean, severity string"
CHOICE = "iri array<string>, disposition string, confidence double, rationale string"


def _read(rows: DataFrame, model: models.Model, prompt: Column, schema: str, name: str) -> DataFrame:
    asked = models.ask(rows.withColumn("prompt", prompt), model).drop("prompt")
    asked = asked.withColumn(name, models.parsed(F.col("answer"), schema))
    return asked.withColumn(f"{name}_error", F.coalesce("error", F.when(F.col(name).isNull(), "the answer is not of the schema"))).drop("answer", "error")


def screen(paragraphs: DataFrame, model: models.Model) -> DataFrame:
    """The paragraphs with screen_keep and screen_justification; what could not be screened is kept, and none is dropped."""
    out = _read(paragraphs, model, F.concat_ws("\n", "heading", "parent_text", "text") if "heading" in paragraphs.columns else F.concat_ws("\n", "parent_text", "text"), SCREEN, "screen")
    return out.select(*paragraphs.columns, F.coalesce("screen.keep", F.lit(True)).alias("screen_keep"), F.coalesce("screen.justification", "screen_error").alias("screen_justification"))


def rename_parents(rows: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """The rows with parent_text replaced, in its place, by parents (an array of struct(iri, text))."""
    met = rows.join(parents.select(*key, "parents"), key, "left")
    return met.select(*("parents" if c == "parent_text" else c for c in rows.columns))


def context(row: DataFrame) -> Column:
    """A paragraph and what surrounds it as the text that a model reads, in a fixed layout.

    Columns: paragraph_iri, unit_type, heading, parents, text, previous and next (structs with text), cross_references (array
    of struct(raw, resolved_iri, text)).
    """
    some = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    lines = lambda label, array: F.when(F.size(array) > 0, F.concat(F.lit(f"{label}:\n"), F.array_join(array, "\n")))
    none = F.array().cast("array<string>")
    parents = F.coalesce(F.transform("parents", lambda p: F.concat(F.lit("- ["), F.coalesce(p["iri"], F.lit("?")), F.lit("] "), F.coalesce(p["text"], F.lit("")))), none)
    refs = F.coalesce(F.transform("cross_references", lambda c: F.concat(F.lit("- "), c["raw"], F.lit(" -> "), F.coalesce(c["resolved_iri"], F.lit("unresolved")), F.when(c["text"].isNotNull(), F.concat(F.lit(": "), c["text"])).otherwise(""))), none)
    return F.concat_ws("\n", some("IRI", F.col("paragraph_iri")), some("UNIT", F.col("unit_type")), some("HEADING", F.col("heading")), lines("PARENTS", parents), some("PREVIOUS", F.col("previous")["text"]), some("TEXT", F.col("text")), some("NEXT", F.col("next")["text"]), lines("REFERENCES", refs))


def extract_statements(paragraphs: DataFrame, model: models.Model, stems: list[str] | None = None) -> DataFrame:
    """Statements of paragraphs: candidates by a first question, each read by a second, then the gates and passes.

    A paragraph whose first question fails, or names nothing, gives one row that doesn't apply, with extractor_error. A
    candidate whose second question fails stays without content, to be reviewed. paragraphs: paragraph_iri, source, unit_type,
    text, parents, cross_references, and what :func:`context` reads.
    """
    facts = ["paragraph_iri", "source", "unit_type", "text", "parents", "cross_references"]
    seen = _read(paragraphs.withColumn("bundle", context(paragraphs)), model, F.concat(F.lit("classify\n"), "bundle"), CANDIDATES, "first")
    none = F.coalesce("first_error", F.when(F.coalesce(F.size("first.candidates"), F.lit(0)) < 1, "empty candidates"))
    failed = seen.where(none.isNotNull()).select(*facts, F.lit(0).alias("emission"), F.lit("NOT_APPLICABLE").alias("statement_class"), F.lit(None).cast("string").alias("anchor"), F.when(F.col("first_error").isNotNull(), "stage1 failure").otherwise("stage1 returned empty list").alias("classification_rationale"), none.alias("extractor_error"))
    each = seen.where(none.isNull()).select(*facts, "bundle", F.posexplode("first.candidates").alias("emission", "c")).select(*facts, "bundle", "emission", "c.statement_class", "c.anchor", F.col("c.rationale").alias("classification_rationale"))
    gate = passes.enumeration_gate(F.col("paragraph_iri"), F.col("parents"))
    asked = each.withColumn("wanted", F.when((gate == "gate") & (F.col("statement_class") != "NOT_APPLICABLE"), "DEONTIC").otherwise(F.col("statement_class")))
    read = asked.where((F.col("wanted") != "NOT_APPLICABLE") & ~((F.col("wanted") == "DEONTIC") & (F.col("unit_type") == "recital")))
    kept = asked.join(read.select("paragraph_iri", "emission"), ["paragraph_iri", "emission"], "left_anti").select(*asked.columns)
    second = _read(read, model, F.concat_ws("\n", F.concat(F.lit("extract "), "wanted"), F.concat(F.lit("anchor: "), F.coalesce("anchor", F.lit(""))), "bundle"), STATEMENT, "s")
    content = [f.split()[0] for f in ("modality", "subject", "predicate", "object", "condition", "beneficiary", "term", "definition", "scope_type", "applies_to", "polarity", "references", "confidence", "applies_to_healthcare", "severity")]
    told = second.select(*facts, "emission", "statement_class", "anchor", "classification_rationale", F.col("s_error").alias("extractor_error"), *(F.col(f"s.{c}").alias(c) for c in content))
    rows = told.unionByName(kept.select(*facts, "emission", "statement_class", "anchor", "classification_rationale"), allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)
    rows = rows.withColumn("needs_review", F.col("extractor_error").isNotNull())
    out = passes.replay(passes.gates(rows), stems)
    parents = F.filter(F.transform("parents", lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return out.withColumns({"paragraph_text": F.col("text"), "parent_texts": F.when(F.size(parents) > 0, parents)})


def reread(sentences: DataFrame, model: models.Model) -> DataFrame:
    """What a second question makes of sentences (id, sentence) that were written from statements: id and the content read back."""
    out = _read(sentences, model, F.concat_ws("\n", F.lit("extract DEONTIC"), F.concat(F.lit("anchor: "), "sentence"), F.concat(F.lit("TEXT: "), "sentence")), STATEMENT, "s")
    return out.select("id", "s.*", F.col("s_error").alias("extractor_error"))


def vocabulary_lines(labels: DataFrame, key: list[str]) -> DataFrame:
    """key and vocabulary: the labels of a slot, by scheme and sorted, as lines of a prompt. labels: key, scheme, iri and label."""
    line = F.concat(F.lit("  "), "iri", F.lit(" ("), F.coalesce("label", F.lit("")), F.lit(")"))
    per = labels.groupBy(*key, "scheme").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("lines"))
    block = F.struct("scheme", F.concat(F.lit("["), F.coalesce("scheme", F.lit("-")), F.lit("]\n"), "lines").alias("text"))
    return per.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["text"]), "\n").alias("vocabulary"))


def adjudicate(rows: DataFrame, allowed: DataFrame, model: models.Model, prompt: Column, key: list[str], least: float = 0.7) -> DataFrame:
    """The rows with iri, disposition, confidence and attempts: the model's choice among the allowed IRIs (key and iri).

    A choice that isn't allowed is asked for once more, with what was wrong; then, or where confidence is under ``least``, the
    row is escalated and chooses nothing. Nothing chosen is literal.
    """
    vocabulary = allowed.groupBy(*key).agg(F.collect_set("iri").alias("_allowed"))
    rows = rows.join(vocabulary, key, "left").withColumn("_allowed", F.coalesce("_allowed", F.array().cast("array<string>")))
    wrong = lambda: F.array_sort(F.array_except(F.coalesce("c.iri", F.array().cast("array<string>")), F.col("_allowed")))
    first = _read(rows.withColumn("_prompt", prompt), model, F.col("_prompt"), CHOICE, "c").withColumns({"_wrong": wrong(), "attempts": F.lit(1)})
    again = first.where((F.size("_wrong") > 0) | F.col("c_error").isNotNull())
    good = first.where((F.size("_wrong") == 0) & F.col("c_error").isNull())
    more = F.concat("_prompt", F.lit("\nNot allowed: "), F.array_join("_wrong", ", "), F.lit("\nChoose again from the list."))
    second = _read(again.drop("c", "c_error", "_wrong").withColumn("_more", F.lit("")).join(again.select(*key, "_prompt", "_wrong").dropDuplicates([*key, "_prompt"]), [*key, "_prompt"], "left"), model, more, CHOICE, "c").drop("_more").withColumns({"_wrong": wrong(), "attempts": F.lit(2)})
    out = good.unionByName(second.select(*good.columns))
    bad = F.col("c_error").isNotNull() | (F.size("_wrong") > 0) | (F.coalesce("c.confidence", F.lit(0.0)) < least)
    chosen = F.when(bad, F.array().cast("array<string>")).otherwise(F.coalesce("c.iri", F.array().cast("array<string>")))
    return out.select(*[c for c in rows.columns if c != "_allowed"], chosen.alias("iri"), F.when(bad, "escalated").when(F.size(chosen) == 0, "literal").otherwise("mapped").alias("disposition"), F.col("c.confidence").alias("confidence"), "attempts")


def emission_order(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows with emission, their place within the key."""
    return rows.withColumn("emission", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def backfill(statements: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The statements with paragraph_text filled in where it is missing and the paragraph is known, and how: had, filled or missing."""
    known = paragraphs.select(F.col("iri").alias("paragraph_iri"), F.col("text").alias("known_text"))
    out = statements.join(known, "paragraph_iri", "left")
    had = F.coalesce("paragraph_text", F.lit("")) != ""
    how = F.when(had, "had").when(F.col("known_text").isNotNull(), "filled").otherwise("missing")
    return out.withColumns({"backfill": how, "paragraph_text": F.when(had, F.col("paragraph_text")).otherwise(F.col("known_text"))}).drop("known_text")


def with_inputs(statements: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The statements with the inputs of their paragraphs (source, unit_type, text, parents, cross_references); those whose paragraph is unknown pass through."""
    return statements.join(paragraphs.withColumnRenamed("iri", "paragraph_iri"), "paragraph_iri", "left")


def stated_values(statements: DataFrame, lists: tuple[str, ...] = ("subject", "predicate", "object"), singles: tuple[str, ...] = ("condition", "beneficiary", "definition", "applies_to")) -> DataFrame:
    """statement_id, field and value of each element that claims to be stated in the text."""
    def of(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast(statements.schema[c].dataType)), lambda e: F.struct(F.lit(c).alias("field"), e["value"].alias("value"), e["method"].alias("method")))

    parts = [of(c) for c in lists if c in statements.columns]
    parts += [F.array(F.struct(F.lit(c).alias("field"), F.col(c)["value"].alias("value"), F.col(c)["method"].alias("method"))) for c in singles if c in statements.columns]
    return statements.select("statement_id", F.explode(F.concat(*parts)).alias("e")).where("e.method = 'STATED' and e.value is not null").select("statement_id", "e.field", "e.value")


def sentences(statements: DataFrame) -> DataFrame:
    """statement_id and the sentence that a deontic statement makes."""
    values = lambda c: F.filter(F.transform(c, lambda e: e["value"]), lambda v: v.isNotNull())
    modal = F.when(F.col("modality") == "OBLIGATION", "shall").when(F.col("modality") == "PROHIBITION", "shall not").when(F.col("modality") == "PERMISSION", "may").when(F.col("modality") == "DISPENSATION", "is not required to")
    return statements.where("statement_class = 'DEONTIC'").select("statement_id", X.serialize(values("subject"), modal, values("predicate"), values("object"), F.col("condition.value")).alias("sentence"))
