"""Gates and post-passes over extracted statements, in their fixed order.

A statement is a row: paragraph_iri, emission (its place in what the model gave), statement_class, modality, subject,
predicate and object (arrays of struct(value, method)), condition, applies_to and definition (such structs), term,
scope_type, polarity, anchor, references, confidence, applies_to_healthcare, needs_review, and beside it what
is known of its paragraph: source, unit_type, text, parents (array of struct(iri, text)) and cross_references
(array of struct(resolved_iri, citation_surface)). Work between the statements of a paragraph is joins and windows on
paragraph_iri, all by one exchange; everything else is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import storage
from tessella.functions import predicates, roles
from tessella.functions import text as X
from tessella.operators import structure

CONFIDENT = 0.7
#: Lead-ins of lists of conditions, of lists of contents, and words that subordinate.
CONDITION_LEADS = (
    r"where\s+(any|one)\s+of\s+the\s+following",
    r"if\s+(any|one)\s+of\s+the\s+following",
    r"at\s+least\s+one\s+of\s+the\s+following\s+applies",
    r"only\s+if\b.{0,40}\bone\s+of\s+the\s+following",
    r"to\s+the\s+extent\s+that\b.{0,40}\bnecessary",
    r"shall\s+not\s+apply\s+(where|if|to\s+the\s+extent)",
    r"applies\s+only\s+(where|when|if)",
    r"(any|one)\s+of\s+the\s+following\s+(cases|situations|circumstances)",
    r"on\s+the\s+basis\s+of\s+(any|one)\s+of\s+the\s+following",
    r"provided\s+that\s+(any|one)\s+of\s+the\s+following",
    r"unless\s+(any|one)\s+of\s+the\s+following\s+applies",
)
CONTENT_LEADS = (
    r"shall\s+be\s*:",
    r"the\s+following\s+(measures|safeguards|information|elements|details|data|categories)",
    r"shall\s+(implement|contain|include|comprise|provide|ensure|consist\s+of)\s+the\s+following",
    r"\bmeans\s*:",
)
SUBORDINATES = r"\b(where|if|unless|provided that|to the extent that|on the basis of)\b"
#: Generic scopes, scopes of recitals that are none, cues of an exception, operators, nouns of an action.
GENERIC_SCOPES = ("ai system", "ai systems", "an ai system", "the ai system", "the ai systems", "high-risk ai system", "high-risk ai systems")
SCOPE_DROPS = ("this regulation", "its rules", "application of the rules")
SCOPE_FLAGS = ("margin of manoeuvre", "member state law")
EXCEPTION_CUES = ("unless", "except", "save where", "save that", "provided that", "shall not apply", "does not apply", "do not apply", "may not be lifted")
OPERATORS = ("prohibit", "require", "permit", "allow", "oblige", "exempt")
ACTION_NOUNS = ("processing", "profiling", "collection", "recording", "organisation", "organization", "structuring", "storage", "adaptation", "alteration", "retrieval", "consultation", "use", "disclosure", "transmission", "dissemination", "transfer", "alignment", "combination", "restriction", "erasure", "destruction", "access", "retention", "disposal", "monitoring", "communication", "notification", "provision")
#: Words that carry no content of a predicate or object, and of a span.
ACTION_STOP = ("may", "shall", "must", "can", "could", "will", "would", "should", "be", "been", "being", "to", "the", "a", "an", "of", "in", "that", "which", "by", "or", "and", "is", "are", "for", "as", "with", "on", "at", "not")
SPAN_STOP = ("a", "an", "the", "this", "that", "these", "those", "of", "to", "in", "on", "at", "by", "for", "and", "or", "as", "with", "is", "are", "be", "been", "being", "shall", "must", "may", "should", "will", "can", "not", "no", "which", "who", "whom", "whose", "his", "her", "him", "their", "them", "they", "it", "its", "he", "she", "such", "any", "all", "where", "when", "whether", "from", "into", "out", "up", "down", "than", "then", "so")
SPAN_LEAST = 4


def _texts() -> Column:
    return F.array().cast("array<string>")


def _values(c: str | Column) -> Column:
    """The values of a slot, those that are there."""
    return F.coalesce(F.filter(F.transform(F.col(c) if isinstance(c, str) else c, lambda e: e["value"]), lambda v: v.isNotNull()), _texts())


def _mark(rows: DataFrame, flag: str, hit: Column, review: bool = True) -> DataFrame:
    """The rows with a flag, and to be reviewed where it is set."""
    hit = F.coalesce(hit, F.lit(False))
    out = rows.withColumn(flag, hit)
    return out.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | F.col(flag)) if review else out


def is_deontic() -> Column:
    return F.col("statement_class") == "DEONTIC"


# ---- gates before the passes


def enumeration_gate(iri: Column, parents: Column) -> Column:
    """gate for a point below a list of conditions, flag for one below a lead-in that may be such, '' for others."""
    plain = F.transform(parents, lambda p: F.struct(p["iri"].alias("iri"), p["text"].alias("text")))
    above = F.filter(F.coalesce(plain, F.array().cast("array<struct<iri:string,text:string>>")), lambda p: iri.startswith(F.concat(F.coalesce(p["iri"], F.lit("")), F.lit("/"))))
    nearest = F.aggregate(above, F.struct(F.lit(-1).alias("n"), F.lit("").alias("text")), lambda s, p: F.when(F.length(F.coalesce(p["iri"], F.lit(""))) > s["n"], F.struct(F.length(F.coalesce(p["iri"], F.lit(""))).alias("n"), F.coalesce(p["text"], F.lit("")).alias("text"))).otherwise(s))
    text, leads = nearest["text"], lambda patterns: "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    gate = F.when(text.rlike(leads(CONTENT_LEADS)), "").when(text.rlike(leads(CONDITION_LEADS)), "gate").when(text.rlike(f"(?i){SUBORDINATES}") & F.rtrim(text).endswith(":"), "flag").otherwise("")
    return F.when(iri.rlike(r"/pt_[0-9a-z]+$") & (F.size(above) > 0), gate).otherwise("")


def coerce_classes(rows: DataFrame) -> DataFrame:
    """Statements of condition points are deontic; below an unknown lead-in they are to be reviewed."""
    gate = enumeration_gate(F.col("paragraph_iri"), F.col("parents"))
    drifted = (gate == "gate") & ~F.col("statement_class").isin("DEONTIC", "NOT_APPLICABLE")
    rows = rows.withColumns({"class_coerced_to_deontic": F.when(drifted, F.col("statement_class")), "statement_class": F.when(drifted, "DEONTIC").otherwise(F.col("statement_class"))})
    return _mark(rows, "unrecognized_enumeration_leadin", (gate == "flag") & (F.col("statement_class") != "NOT_APPLICABLE"))


def suppress_recitals(rows: DataFrame) -> DataFrame:
    """Deontic statements of recitals count as not applicable, and say why."""
    hit = is_deontic() & (F.col("unit_type") == "recital")
    reason = F.concat(F.lit("DEONTIC suppressed on recital — "), F.coalesce("classification_rationale", F.lit("")))
    return rows.withColumns({"classification_rationale": F.when(hit, reason).otherwise(F.col("classification_rationale")), "statement_class": F.when(hit, "NOT_APPLICABLE").otherwise(F.col("statement_class"))})


def drop_legislator_subjects(rows: DataFrame) -> DataFrame:
    """Without deontic statements whose every named subject is a law."""
    named = F.filter(F.transform(_values("subject"), lambda v: F.lower(F.trim(v))), lambda v: v != "")
    return rows.where(~F.coalesce(is_deontic() & (F.size(named) > 0) & F.forall(named, lambda v: v.rlike("(^| )law$")), F.lit(False)))


def own_source(rows: DataFrame) -> DataFrame:
    """The paragraph is the source, whatever the model says."""
    return rows.withColumn("source_article", F.col("paragraph_iri"))


def confidence_gate(rows: DataFrame, least: float = CONFIDENT) -> DataFrame:
    return rows.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | F.coalesce(F.col("confidence") < least, F.lit(False)))


def ungrounded(rows: DataFrame) -> Column:
    """Whether an element of a slot that makes the statement rests on a citation alone."""
    cites = lambda c: F.coalesce(F.exists(c, lambda e: e["method"] == "CITATION"), F.lit(False))
    one = lambda c: F.coalesce(F.col(c)["method"] == "CITATION", F.lit(False))
    return F.when(is_deontic(), cites("subject") | cites("predicate")).when(F.col("statement_class") == "DEFINITIONAL", one("definition")).when(F.col("statement_class") == "APPLICABILITY", one("applies_to")).otherwise(False)


def blank_slots(rows: DataFrame) -> Column:
    """Whether a slot that a statement of its class must have is missing, empty or blank throughout, or the condition is there but blank."""
    empty = lambda c: F.coalesce(F.forall(c, lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) == ""), F.lit(True))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    condition = F.col("condition").isNotNull() & blank(F.col("condition.value"))
    return F.when(is_deontic(), empty("subject") | empty("predicate") | empty("object") | condition).when(F.col("statement_class") == "DEFINITIONAL", blank(F.col("term")) | blank(F.col("definition.value"))).when(F.col("statement_class") == "APPLICABILITY", blank(F.col("applies_to.value")) | condition).otherwise(False)


def scan_text(rows: DataFrame) -> Column:
    """What the relevance gate reads of a statement, in lower case: who, what and when, not the predicate."""
    one = lambda c: F.array(F.col(c)["value"])
    parts = F.when(is_deontic(), F.concat(_values("subject"), _values("object"), one("condition"))).when(F.col("statement_class") == "APPLICABILITY", F.concat(one("applies_to"), one("condition"))).when(F.col("statement_class") == "DEFINITIONAL", F.concat(F.array("term"), one("definition"))).otherwise(_texts())
    return F.lower(F.array_join(F.array_compact(parts), " "))


def relevance_gate(rows: DataFrame, dimensions: dict[str, list[str]], derogations: str, bases: tuple[str, ...], excluded: tuple[str, ...]) -> DataFrame:
    """applies_to_healthcare, profile_dimensions_matched and profile_gate_override by the rules of a profile.

    First the operative basis, whatever the model said: paragraphs below ``derogations`` apply only where they are among the
    ``bases``, and those below an ``excluded`` prefix never. Then, where the model said yes: a scope that excludes, a scope of
    legal persons and a text that names no dimension don't apply. Each no of a rule is to be reviewed.
    """
    source = F.col("paragraph_iri")
    said = F.coalesce("applies_to_healthcare", F.lit(False))
    outside = source.startswith(derogations) & ~source.isin(*bases)
    area = F.lit(False)
    for p in excluded:
        area = area | source.startswith(p)
    text = scan_text(rows)
    matched = F.array_compact(F.array(*(F.when(X.contains_any(text, words), F.lit(name)) for name, words in dimensions.items())))
    scope = F.col("statement_class") == "APPLICABILITY"
    why = (
        F.when(outside, "outside the operative special-category basis")
        .when(area, "outside the operative high-risk basis")
        .when(~said, None)
        .when(scope & (F.col("polarity") == "EXCLUDES"), "a scope that excludes is a carve-out")
        .when(scope & F.contains(F.lower(F.coalesce(F.col("applies_to.value"), F.lit(""))), F.lit("legal person")), "the scope is legal persons")
        .when(F.size(matched) == 0, "no dimension of the profile is named")
    )
    gated = (F.col("statement_class") != "NOT_APPLICABLE") & F.col("applies_to_healthcare").isNotNull()
    rows = rows.withColumn("profile_gate_override", F.when(gated, why))
    refused = F.col("profile_gate_override").isNotNull()
    rows = rows.withColumn("profile_dimensions_matched", F.when(gated & said & ~refused, matched))
    rows = rows.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | refused)
    return rows.withColumn("applies_to_healthcare", F.when(refused, F.lit(False)).otherwise(F.col("applies_to_healthcare")))


def merge_not_applicable(rows: DataFrame) -> DataFrame:
    """One row for all of a paragraph's statements that don't apply, with their different reasons in order, joined by ' | '."""
    none = F.col("statement_class") == "NOT_APPLICABLE"
    w = Window.partitionBy("paragraph_iri", none)
    reasons = F.array_sort(F.collect_list(F.struct("emission", F.coalesce("classification_rationale", F.lit("")).alias("why"))).over(w))
    joined = F.array_join(F.array_distinct(F.transform(reasons, lambda r: r["why"])), " | ")
    rows = rows.withColumns({"_first": F.min("emission").over(w), "_reasons": joined})
    rows = rows.where(~none | (F.col("emission") == F.col("_first"))).dropDuplicates(["paragraph_iri", "emission"])
    return rows.withColumn("classification_rationale", F.when(none, F.col("_reasons")).otherwise(F.col("classification_rationale"))).drop("_first", "_reasons")


# ---- passes


def normalise_predicates(rows: DataFrame) -> DataFrame:
    """Predicates without scaffolding, verbs in base form; a negation against the modality stays and is to be reviewed."""
    told = F.transform("predicate", lambda e: F.struct(e.alias("e"), predicates.normalised(e["value"], F.col("modality")).alias("n")))
    rows = rows.withColumn("_told", F.when(is_deontic(), told))
    clean = F.transform("_told", lambda x: F.struct(x["n"]["text"].alias("value"), x["e"]["method"].alias("method")))
    against = F.filter("_told", lambda x: x["n"]["contradiction"])
    rows = rows.withColumns({"predicate": F.when(F.col("_told").isNotNull(), clean).otherwise(F.col("predicate")), "predicate_negation_contradiction": F.when(F.size(against) > 0, F.element_at(against, -1)["e"]["value"])})
    return rows.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | F.col("predicate_negation_contradiction").isNotNull()).drop("_told")


def annex_area(rows: DataFrame) -> DataFrame:
    """A generic scope in an area of the third annex, or a point of one, is what the paragraph's own text names."""
    iri, text = F.col("paragraph_iri"), F.coalesce("text", F.lit(""))
    point = iri.rlike(r"^aiact:anx_III/par_\d+/pt_[a-z]+$")
    own = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?s)^\s*\(\w+\)\s*(?=.)", "")), "[;.]+$", "")
    area = F.trim(F.regexp_replace(F.trim(F.split(F.regexp_replace(text, r"(?s)^\s*\d+\.\s*(?=.)", ""), r",\s*in so far as|:", 2)[0]), ",+$", ""))
    name = F.nullif(F.trim(F.when(point, own).when(iri.rlike(r"^aiact:anx_III/par_\d+$") & ~iri.endswith("/par_0"), area)), F.lit(""))
    generic = (F.col("statement_class") == "APPLICABILITY") & F.lower(F.trim(F.col("applies_to.value"))).isin(*GENERIC_SCOPES)
    rows = _mark(rows, "annex_area_applies_to_fixed", generic & name.isNotNull(), review=False)
    return rows.withColumn("applies_to", F.when(F.col("annex_area_applies_to_fixed"), F.struct(name.alias("value"), F.lit("STATED").alias("method"))).otherwise(F.col("applies_to")))


def canonicalise_subjects(rows: DataFrame, stems: list[str] | None = None) -> DataFrame:
    """Subjects in their canonical phrases; where none names an actor and all are acted upon, the bearer of the duty in their place.

    What is replaced goes to the object or the condition. A subject that is neither is kept and to be reviewed, and so is an
    actor of the other regulation.
    """
    element = lambda v, m: F.struct(v.alias("value"), m.alias("method"))
    snapped = F.transform(F.coalesce("subject", F.array().cast("array<struct<value:string,method:string>>")), lambda e: element(roles.snapped_role(e["value"]), e["method"]))
    rows = rows.withColumn("subject", F.when(is_deontic(), snapped).otherwise(F.col("subject")))
    default = F.lit(None).cast("string")
    for source, bearer in roles.DEFAULT_BEARER.items():
        default = F.when(F.col("source") == source, bearer).otherwise(default)
    values = F.filter(_values("subject"), lambda v: v != "")
    nameless = is_deontic() & default.isNotNull() & ~F.exists(_values("subject"), lambda v: roles.names_actor(v, stems))
    rows = rows.withColumn("_nameless", nameless)
    nameless = F.col("_nameless")
    replaced = nameless & F.forall(values, lambda v: roles.is_patient(v, F.col("text")))
    parents = F.transform("parents", lambda p: F.coalesce(p["text"], F.lit("")))
    bearer = F.coalesce(roles.inferred_bearer(parents, F.coalesce("text", F.lit(""))), default)
    rows = rows.withColumns({"_dropped": F.when(replaced, values).otherwise(_texts()), "_bearer": bearer, "_kept": nameless & ~replaced})
    rows = _mark(rows, "subject_inferred_duty_bearer", replaced, review=False)
    within = lambda a, b: (F.trim(a) != "") & (F.contains(F.lower(b), F.lower(F.trim(a))) | F.contains(F.lower(F.trim(a)), F.lower(b)))
    slots = F.struct(F.coalesce("object", F.array().cast("array<struct<value:string,method:string>>")).alias("object"), F.col("condition").alias("condition"))

    def rehome(s: Column, v: Column) -> Column:
        slot, there = roles.dropped_slot(F.col("modality"), v), F.coalesce(s["condition"]["value"], F.lit(""))
        objects = F.when((slot == "object") & ~F.exists(s["object"], lambda e: F.coalesce(within(v, F.coalesce(e["value"], F.lit(""))), F.lit(False))), F.concat(s["object"], F.array(element(v, F.lit("STATED"))))).otherwise(s["object"])
        condition = F.when((slot == "condition") & (there == ""), element(v, F.lit("STATED"))).when((slot == "condition") & ~within(v, there), element(F.concat_ws(" ", v, there), F.lit("STATED"))).otherwise(s["condition"])
        return F.struct(objects.alias("object"), condition.alias("condition"))

    rows = rows.withColumn("_slots", F.aggregate("_dropped", slots, rehome))
    on = F.col("subject_inferred_duty_bearer")
    rows = rows.withColumns({"object": F.when(on, F.col("_slots.object")).otherwise(F.col("object")), "condition": F.when(on, F.col("_slots.condition")).otherwise(F.col("condition")), "subject": F.when(on, F.array(element(F.col("_bearer"), F.lit("CONTEXT")))).otherwise(F.col("subject"))})
    rows = _mark(rows, "subject_unrecognized_actor", F.col("_kept")).drop("_nameless", "_dropped", "_bearer", "_kept", "_slots")
    foreign = F.lit(None).cast("array<string>")
    for source, names in roles.FOREIGN.items():
        foreign = F.when(F.col("source") == source, F.array(*map(F.lit, names))).otherwise(foreign)
    wrong = F.when(is_deontic(), X.let(F.array_intersect(_values("subject"), foreign), lambda w: F.when(F.size(w) > 0, F.array_join(F.array_sort(w), ", "))))
    rows = rows.withColumn("subject_vocabulary_mismatch", wrong)
    return rows.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | F.col("subject_vocabulary_mismatch").isNotNull())


def guard_recital_scopes(rows: DataFrame) -> DataFrame:
    """Without scopes of recitals that are the regulation itself; those that may be no scope are to be reviewed."""
    scope = (F.col("statement_class") == "APPLICABILITY") & (F.col("unit_type") == "recital")
    value = F.coalesce(F.col("applies_to.value"), F.lit(""))
    kept = rows.where(~F.coalesce(scope & X.contains_any(value, list(SCOPE_DROPS)), F.lit(False)))
    return _mark(kept, "recital_scope_unverified", scope & X.contains_any(value, list(SCOPE_FLAGS)))


def _stems(text: Column, stop: tuple[str, ...] = ()) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words, X.stem))


def merge_exception_splits(rows: DataFrame, inside: float = 0.8, mirror: float = 0.6) -> DataFrame:
    """Without exceptions that only repeat their rule's own condition; mirrors with a cue of an exception are to be reviewed.

    The rule of a dispensation is the paragraph's obligation, that of a prohibition its permission, of the largest overlap
    of predicate and object, the first emitted of equal ones.
    """
    rows = rows.withColumns({"_p": _stems(F.array_join(_values("predicate"), " "), ACTION_STOP), "_o": _stems(F.array_join(_values("object"), " "), ACTION_STOP), "_c": _stems(F.coalesce(F.col("condition.value"), F.lit(""))), "_r": F.array_sort(F.array_distinct(F.filter(F.coalesce("references", _texts()), lambda r: ~F.contains(r, F.lit("#"))))), "_text": F.coalesce(F.col("condition.value"), F.lit(""))})
    of = F.when(F.col("modality") == "DISPENSATION", "OBLIGATION").when(F.col("modality") == "PROHIBITION", "PERMISSION")
    s = rows.where(is_deontic() & (F.size("_p") > 0) & (F.size("_o") > 0)).select("paragraph_iri", "emission", F.col("modality").alias("own"), of.alias("modality"), "_p", "_o", "_c", "_r", "_text").where("modality is not null")
    rule = rows.where(is_deontic()).select("paragraph_iri", "modality", F.col("emission").alias("p_emission"), *(F.col(c).alias(f"p{c}") for c in ("_p", "_o", "_c", "_r")))
    overlap = F.size(F.array_intersect("_p", "p_p")) + F.size(F.array_intersect("_o", "p_o"))
    best = s.join(rule.hint("merge"), ["paragraph_iri", "modality"]).withColumn("_best", F.row_number().over(Window.partitionBy("paragraph_iri", "emission").orderBy(F.desc(overlap), "p_emission"))).where("_best = 1")
    best = best.where(X.containment(F.col("_p"), F.col("p_p"), mirror) & X.containment(F.col("_o"), F.col("p_o"), mirror))
    repeats = X.containment(F.col("_c"), F.col("p_c"), inside)
    unsure = ~repeats & X.contains_any(F.col("_text"), list(EXCEPTION_CUES)) & (F.col("_r") == F.col("p_r"))
    best = best.select("paragraph_iri", "emission", "p_emission", F.col("own").alias("dropped_modality"), F.col("_text").alias("dropped_condition"), repeats.alias("repeats"), unsure.alias("unsure"))
    # what is said of a statement by its exceptions and its rule, in one row: a rule names the last exception that it has taken in
    own = F.struct("emission", F.col("repeats").alias("gone"), F.lit(None).cast("struct<at:int,m:struct<dropped_modality:string,dropped_condition:string>>").alias("taken"), "unsure")
    taken = F.when(F.col("repeats"), F.struct(F.col("emission").cast("int").alias("at"), F.struct("dropped_modality", "dropped_condition").alias("m")))
    rules = F.struct(F.col("p_emission").alias("emission"), F.lit(False).alias("gone"), taken.alias("taken"), "unsure")
    told = best.where("repeats or unsure").select("paragraph_iri", F.explode(F.array(own, rules)).alias("t")).groupBy("paragraph_iri", F.col("t.emission").alias("emission"))
    told = told.agg(F.bool_or("t.gone").alias("_gone"), F.max("t.taken")["m"].alias("merged_exception_split"), F.bool_or("t.unsure").alias("_unsure"))
    out = rows.drop("_p", "_o", "_c", "_r", "_text").join(told.hint("merge"), ["paragraph_iri", "emission"], "left").where("not coalesce(_gone, false)")
    return _mark(out, "exception_split_ambiguous", F.col("_unsure")).drop("_unsure", "_gone")


def rank_statements(rows: DataFrame) -> DataFrame:
    """statement_id by the canonical order within the paragraph; what doesn't apply is '#na'.

    The order is by class and then: modality, predicates and objects; the term; scope, polarity and what it applies to.
    """
    joined = lambda c: F.lower(F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<value:string,method:string>>")), lambda e: F.coalesce(e["value"], F.lit(""))), " "))
    empty, low = F.lit(""), lambda c: F.lower(F.coalesce(c, F.lit("")))
    of = lambda d, t, a: F.when(is_deontic(), d).when(F.col("statement_class") == "DEFINITIONAL", t).when(F.col("statement_class") == "APPLICABILITY", a).otherwise(empty)
    keys = [of(F.coalesce("modality", empty), low(F.col("term")), F.coalesce("scope_type", empty)), of(joined("predicate"), empty, F.coalesce("polarity", empty)), of(joined("object"), empty, low(F.col("applies_to.value")))]
    none = F.col("statement_class") == "NOT_APPLICABLE"
    rank = F.row_number().over(Window.partitionBy("paragraph_iri", none).orderBy("statement_class", *keys, "emission"))
    return rows.withColumn("statement_id", F.concat("paragraph_iri", F.lit("#"), F.when(none, "na").otherwise(F.concat(F.lit("s"), rank.cast("string")))))


def link_parents(rows: DataFrame) -> DataFrame:
    """References of permissions and dispensations extended by their rule in the paragraph, by overlap of words and then order."""
    text = F.concat_ws(" ", F.array_join(_values("object"), " "), F.array_join(_values("predicate"), " "), F.col("condition.value"))
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    s = rows.where(is_deontic()).select("paragraph_iri", "statement_id", "emission", "modality", words.alias("words"))
    rule = F.when(F.col("modality") == "PERMISSION", "PROHIBITION").when(F.col("modality") == "DISPENSATION", "OBLIGATION")
    rules = s.select("paragraph_iri", F.col("modality").alias("rule"), F.col("statement_id").alias("parent_id"), F.col("emission").alias("p_emission"), F.col("words").alias("p_words"))
    met = s.withColumn("rule", rule).where("rule is not null").join(rules.hint("merge"), ["paragraph_iri", "rule"])
    best = met.groupBy("paragraph_iri", "statement_id").agg(F.max_by("parent_id", F.struct(F.size(F.array_intersect("words", "p_words")), -F.col("p_emission"))).alias("parent_id"))
    out = rows.join(best.hint("merge"), ["paragraph_iri", "statement_id"], "left")
    none = F.coalesce("references", _texts())
    out = _mark(out, "intra_paragraph_inferred", F.col("parent_id").isNotNull() & ~F.coalesce(F.array_contains(none, F.col("parent_id")), F.lit(False)), review=False)
    return out.withColumn("references", F.when(F.col("intra_paragraph_inferred"), F.concat(none, F.array("parent_id"))).otherwise(F.col("references"))).drop("parent_id")


def span_text(rows: DataFrame) -> Column:
    """The text that a statement covers, in lower case: its anchor and the slots of its class."""
    one = lambda c: F.array(F.col(c)["value"])
    more = F.array(F.col("beneficiary")["value"]) if "beneficiary" in rows.columns else _texts()
    parts = F.when(is_deontic(), F.concat(_values("predicate"), _values("object"), _values("subject"), one("condition"), more)).when(F.col("statement_class") == "APPLICABILITY", F.concat(one("applies_to"), one("condition"))).when(F.col("statement_class") == "DEFINITIONAL", F.concat(F.array("term"), one("definition"))).otherwise(_texts())
    return F.lower(F.array_join(F.filter(F.concat(F.array("anchor"), parts), lambda p: F.coalesce(p != "", F.lit(False))), " "))


def flag_smeared_references(rows: DataFrame) -> DataFrame:
    """Statements that carry references of the paragraph, but in whose span none of the citations stands."""
    hits = F.filter("cross_references", lambda c: F.coalesce(F.array_contains(F.col("references"), c["resolved_iri"]), F.lit(False)) & (F.coalesce(c["citation_surface"], F.lit("")) != ""))
    carried = F.coalesce(F.transform(hits, lambda c: F.lower(c["citation_surface"])), _texts())
    rows = rows.withColumns({"_span": span_text(rows), "_carried": carried})
    out = _mark(rows, "references_unattributed", (F.size("_carried") > 0) & ~F.exists("_carried", lambda c: F.contains(F.col("_span"), c)))
    return out.drop("_span", "_carried")


def flag_truncated_spans(rows: DataFrame, least: int = SPAN_LEAST) -> DataFrame:
    """Deontic statements of a paragraph that has a run of words which no slot of any of them covers."""
    covered = F.array_distinct(F.flatten(F.collect_set(F.when(is_deontic(), _stems(span_text(rows), SPAN_STOP))).over(Window.partitionBy("paragraph_iri"))))
    words = F.filter(F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s*\d+\.\s*", "")), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*SPAN_STOP))
    rows = rows.withColumns({"_words": words, "_covered": covered})
    rows = rows.withColumn("_run", structure.longest_uncovered(F.col("_words"), lambda w: F.array_contains(F.col("_covered"), X.stem(w))))
    found = F.array_join(F.slice("_words", F.col("_run.start") + 1, F.col("_run.length")), " ")
    rows = rows.withColumn("span_coverage_truncated", F.when(is_deontic() & (F.col("_run.length") >= least), found))
    return rows.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | F.col("span_coverage_truncated").isNotNull()).drop("_words", "_covered", "_run")


def head_word(text: Column) -> Column:
    """The first word, past one leading determiner."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    first = F.try_element_at(words, F.lit(1))
    return F.coalesce(F.when(first.isin(*predicates.DETERMINERS, "its", "such"), F.try_element_at(words, F.lit(2))), first, F.lit(""))


def flag_operator_predicates(rows: DataFrame) -> DataFrame:
    """Statements whose predicate is the modality's own verb and whose object names the action."""
    head = head_word(F.try_element_at(F.transform("predicate", lambda e: e["value"]), F.lit(1)))
    acts = F.exists(_values("object"), lambda v: head_word(v).isin(*ACTION_NOUNS))
    return _mark(rows, "predicate_is_deontic_operator", is_deontic() & head.isin(*OPERATORS) & ((F.col("modality") == "DISPENSATION") | acts))


def flag_redundant_negation(rows: DataFrame) -> DataFrame:
    """Prohibitions whose predicate negates once more."""
    negates = F.exists(_values("predicate"), lambda v: F.lower(v).rlike(r"no longer|(?<![a-z])(?:not|never)(?![a-z])"))
    return _mark(rows, "predicate_redundant_negation", is_deontic() & (F.col("modality") == "PROHIBITION") & negates)


def gates(rows: DataFrame) -> DataFrame:
    """What is done to single statements before the passes, that needs no profile."""
    rows = suppress_recitals(coerce_classes(rows))
    return merge_not_applicable(confidence_gate(own_source(drop_legislator_subjects(rows))))


def replay(rows: DataFrame, stems: list[str] | None = None) -> DataFrame:
    """The passes, which need no model: rewriting before the drops, drops before ids, ids before links, flags last.

    Statements are stored, as columns, before each pass that joins them with others of their paragraph, so that no side of
    a join rewrites them again. What is stored is small beside its rows, so these joins say that they sort and don't broadcast.
    """
    rows = storage.stored(guard_recital_scopes(canonicalise_subjects(annex_area(normalise_predicates(rows)), stems)))
    rows = link_parents(storage.stored(rank_statements(merge_exception_splits(rows))))
    rows = flag_truncated_spans(flag_smeared_references(rows))
    return flag_redundant_negation(flag_operator_predicates(rows))
