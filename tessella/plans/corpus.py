"""Queries over statements, vocabularies and answers, each beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import storage
from tessella.functions import predicates
from tessella.functions import text as X
from tessella.operators import answer, candidates, evaluate, extract, gold, graph, passes
from tessella.plans.registry import query as _query
from tessella.plans.registry import table as _t

_EL = "array<struct<value:string,method:string>>"


def _one(value, method="STATED"):
    return F.struct(value.cast("string").alias("value"), F.lit(method).alias("method"))


def _statements(rows: DataFrame, **columns) -> DataFrame:
    """Statement rows with the columns given and nothing in the others."""
    none = {"source": "string", "unit_type": "string", "text": "string", "parents": "array<struct<iri:string,text:string>>", "cross_references": "array<struct<resolved_iri:string,citation_surface:string>>", "paragraph_iri": "string", "emission": "int", "statement_class": "string", "modality": "string", "subject": _EL, "predicate": _EL, "object": _EL, "condition": "struct<value:string,method:string>", "applies_to": "struct<value:string,method:string>", "definition": "struct<value:string,method:string>", "term": "string", "scope_type": "string", "polarity": "string", "anchor": "string", "references": "array<string>", "confidence": "double", "applies_to_healthcare": "boolean", "needs_review": "boolean", "classification_rationale": "string"}
    keep = [c for c in columns if c not in none]
    return rows.select(*(columns[c].alias(c) for c in keep), *((columns[k] if k in columns else F.lit(None)).cast(t).alias(k) for k, t in none.items()))


_MODALITY = "['OBLIGATION','PROHIBITION','PERMISSION','DISPENSATION'][(l_suppkey % 4 + 1)::INT]"


def _modality():
    return F.element_at(F.array(*map(F.lit, ("OBLIGATION", "PROHIBITION", "PERMISSION", "DISPENSATION"))), (F.col("l_suppkey") % 4 + 1).cast("int"))


_EMITTED = """l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_returnflag FROM lineitem),
e AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_returnflag) - 1)::INT AS emission FROM l)"""


def _emitted(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag").distinct()
    return extract.emission_order(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag"])


# X2, X3, X33, X32, J35, W3, J36, UD4: line items as statements of their order
@_query(f"""WITH {_EMITTED}, s AS (SELECT 'gdpr:art_' || l_orderkey AS p, emission, {_MODALITY} AS m, ['process', 'erase', 'notify'][(l_partkey % 3 + 1)::INT] AS v,
  'data kind ' || lower(l_returnflag) AS o, l_returnflag AS f, l_discount > 0.04 AS c FROM e),
best AS (SELECT s.p, s.emission, arg_max(r.emission, ((CASE WHEN r.v = s.v THEN 1 ELSE 0 END + CASE WHEN r.o = s.o AND s.f <> 'A' THEN 1 ELSE 0 END), -r.emission)) AS r FROM s JOIN s r ON r.p = s.p
  AND r.m = CASE s.m WHEN 'DISPENSATION' THEN 'OBLIGATION' WHEN 'PROHIBITION' THEN 'PERMISSION' END GROUP BY ALL),
gone AS (SELECT b.p, b.emission, b.r FROM best b JOIN s ON s.p = b.p AND s.emission = b.emission JOIN s r ON r.p = b.p AND r.emission = b.r WHERE r.v = s.v AND s.c AND r.c),
k AS (SELECT * FROM s WHERE (p, emission) NOT IN (SELECT (p, emission) FROM gone)),
i AS (SELECT *, p || '#s' || row_number() OVER (PARTITION BY p ORDER BY m, v, o, emission) AS id FROM k),
w AS (SELECT *, list_distinct(string_split(o || ' ' || v || CASE WHEN c THEN ' where consent was given' ELSE '' END, ' ')) AS t FROM i),
up AS (SELECT x.id, arg_max(y.id, (len(list_intersect(x.t, y.t)), -y.emission)) AS parent FROM w x JOIN w y ON x.p = y.p AND y.m = CASE x.m WHEN 'PERMISSION' THEN 'PROHIBITION' WHEN 'DISPENSATION' THEN 'OBLIGATION' END GROUP BY x.id)
SELECT i.p AS paragraph_iri, i.id AS statement_id, i.m AS modality, i.v AS verb, coalesce(up.parent, '') AS parent, (i.p, i.emission) IN (SELECT (p, r) FROM gone) AS merged FROM i LEFT JOIN up ON up.id = i.id""")
def postpass_replay(spark, d):
    verb = F.element_at(F.array(F.lit("shall process"), F.lit("must be erased"), F.lit("to notify")), (F.col("l_partkey") % 3 + 1).cast("int"))
    condition = F.when(F.col("l_discount") > 0.04, _one(F.lit("where consent was given")))
    rows = _statements(_emitted(spark, d), source=F.lit("gdpr"), unit_type=F.lit("article"), paragraph_iri=F.concat(F.lit("gdpr:art_"), F.col("l_orderkey").cast("string")), emission=F.col("emission"), statement_class=F.lit("DEONTIC"), modality=_modality(), subject=F.array(_one(F.lit("The data controller"))), predicate=F.array(_one(verb)), object=F.array(_one(F.concat(F.lit("data kind "), F.lower("l_returnflag")))), condition=condition)
    out = passes.replay(rows)
    return out.select("paragraph_iri", "statement_id", "modality", F.col("predicate")[0]["value"].alias("verb"), F.coalesce(F.try_element_at("references", F.lit(1)), F.lit("")).alias("parent"), F.col("merged_exception_split").isNotNull().alias("merged"))


# F6-F8, F10, X27, UD6, A29: gates on line items as what a model gave for their order
@_query(f"""WITH {_EMITTED}, s AS (SELECT l_orderkey AS o, emission, l_linenumber AS n, l_partkey, l_discount, ['DEONTIC','DEFINITIONAL','NOT_APPLICABLE'][(l_partkey % 3 + 1)::INT] AS c FROM e),
t AS (SELECT *, CASE WHEN o % 4 = 0 AND c = 'DEFINITIONAL' THEN 'DEONTIC' ELSE c END AS k FROM s),
u AS (SELECT *, CASE WHEN k = 'DEONTIC' AND o % 5 = 0 THEN 'NOT_APPLICABLE' ELSE k END AS z, CASE WHEN k = 'DEONTIC' AND o % 5 = 0 THEN 'DEONTIC suppressed on recital — ' ELSE '' END || 'line ' || n AS why FROM t),
v AS (SELECT * FROM u WHERE NOT (z = 'DEONTIC' AND n % 2 = 0)),
na AS (SELECT o, min(emission) AS emission, list(why ORDER BY emission) AS whys FROM v WHERE z = 'NOT_APPLICABLE' GROUP BY o)
SELECT v.o AS l_orderkey, v.emission, v.z AS statement_class, CASE WHEN v.z = 'NOT_APPLICABLE' THEN array_to_string(list_transform(list_filter(range(1, len(na.whys) + 1), lambda i: list_position(na.whys, na.whys[i]) = i), lambda i: na.whys[i]), ' | ') ELSE v.why END AS why,
  v.c = 'DEFINITIONAL' AND v.o % 4 = 0 AS coerced, v.l_discount * 10 < 0.7 OR v.o % 4 = 1 AND v.k <> 'NOT_APPLICABLE' AS needs_review
FROM v LEFT JOIN na ON na.o = v.o WHERE v.z <> 'NOT_APPLICABLE' OR v.emission = na.emission""")
def statement_gates(spark, d):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    lead = F.when(o % 4 == 0, "shall be lawful only if and to the extent that at least one of the following applies:").when(o % 4 == 1, "The rule holds where, in short:").otherwise("It shall include the following:")
    iri = F.concat(F.lit("gdpr:art_"), o.cast("string"), F.lit("/par_1"))
    subject = F.when(n % 2 == 0, F.array(_one(F.lit("Member State law")), _one(F.lit(" ")))).otherwise(F.array(_one(F.lit("national law")), _one(F.lit("the controller"))))
    rows = _statements(_emitted(spark, d), l_orderkey=o, source=F.lit("gdpr"), unit_type=F.when(o % 5 == 0, "recital").otherwise("article"), paragraph_iri=F.concat(iri, F.lit("/pt_a")), parents=F.array(F.struct(F.lit("gdpr").alias("iri"), F.lit("where one of the following").alias("text")), F.struct(iri.alias("iri"), lead.alias("text"))), emission=F.col("emission"), statement_class=F.element_at(F.array(*map(F.lit, ("DEONTIC", "DEFINITIONAL", "NOT_APPLICABLE"))), (F.col("l_partkey") % 3 + 1).cast("int")), subject=subject, confidence=F.col("l_discount") * 10, classification_rationale=F.concat(F.lit("line "), n.cast("string")))
    return passes.gates(rows).select("l_orderkey", "emission", "statement_class", F.col("classification_rationale").alias("why"), F.col("class_coerced_to_deontic").isNotNull().alias("coerced"), "needs_review")


_DIMENSIONS = {"data": ["automobile", "health data"], "device": ["machinery"]}


# F12, F13
@_query("""WITH r AS (SELECT c_custkey AS k, c_nationkey % 3 AS c, c_acctbal > 0 AS said, lower(c_mktsegment) AS seg,
  CASE WHEN c_custkey % 7 = 0 THEN 'out' WHEN c_custkey % 7 = 1 THEN 'in' WHEN c_custkey % 7 = 2 THEN 'area' ELSE 'plain' END AS place, c_custkey % 11 = 0 AS excludes, c_custkey % 13 = 0 AS legal FROM customer),
m AS (SELECT *, CASE WHEN place IN ('out', 'area') THEN 'basis' WHEN NOT said THEN NULL WHEN c = 1 AND excludes THEN 'carve' WHEN c = 1 AND legal THEN 'legal' WHEN seg NOT IN ('automobile', 'machinery') THEN 'none' END AS why FROM r)
SELECT k AS c_custkey, coalesce(why, '') AS why, said AND why IS NULL AS applies, CASE WHEN said AND why IS NULL THEN CASE seg WHEN 'automobile' THEN 'data' ELSE 'device' END ELSE '' END AS dimensions, why IS NOT NULL AS needs_review FROM m""")
def relevance_gate(spark, d):
    k = F.col("c_custkey")
    source = F.when(k % 7 == 0, "gdpr:art_9/par_2/pt_c").when(k % 7 == 1, "gdpr:art_9/par_2/pt_a").when(k % 7 == 2, "aiact:anx_III/par_4").otherwise("gdpr:art_5/par_1")
    text = F.concat(F.lit("of "), F.lower("c_mktsegment"), F.when(k % 13 == 0, " of a Legal Person").otherwise(""))
    rows = _statements(_t(spark, d, "customer"), c_custkey=k, paragraph_iri=source, statement_class=F.element_at(F.array(*map(F.lit, ("DEONTIC", "APPLICABILITY", "DEFINITIONAL"))), (F.col("c_nationkey") % 3 + 1).cast("int")), object=F.array(_one(text)), applies_to=_one(text), term=text, polarity=F.when(k % 11 == 0, "EXCLUDES").otherwise("INCLUDES"), applies_to_healthcare=F.col("c_acctbal") > 0)
    out = passes.relevance_gate(rows, _DIMENSIONS, "gdpr:art_9/par_2/pt_", ("gdpr:art_9/par_2/pt_a", "gdpr:art_9/par_2/pt_h"), ("aiact:anx_III/par_",))
    why = F.col("profile_gate_override")
    short = F.when(F.contains(why, F.lit("basis")), "basis").when(F.contains(why, F.lit("carve-out")), "carve").when(F.contains(why, F.lit("legal")), "legal").when(why.isNotNull(), "none").otherwise("")
    return out.select("c_custkey", short.alias("why"), F.col("applies_to_healthcare").alias("applies"), F.coalesce(F.array_join("profile_dimensions_matched", ","), F.lit("")).alias("dimensions"), "needs_review")


# Who must act, and where what doesn't act goes
@_query("""WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS s, ['OBLIGATION','PROHIBITION','PERMISSION','DISPENSATION'][(o_custkey % 4 + 1)::INT] AS m, o_custkey % 3 = 0 AS ai FROM orders)
SELECT o_orderkey, CASE s WHEN 0 THEN 'the controller' WHEN 1 THEN 'the notified body' WHEN 2 THEN 'the notified body' WHEN 3 THEN 'Large firms' ELSE 'any notified bodies' END AS subject,
  CASE WHEN s = 1 AND (m IN ('OBLIGATION', 'PROHIBITION') OR m = 'PERMISSION') THEN 'tests|A data record' ELSE 'tests' END AS objects,
  CASE WHEN s = 1 AND m = 'DISPENSATION' THEN 'A data record where asked' ELSE 'where asked' END AS condition,
  s IN (1, 2) AS inferred, s = 3 AS unknown, CASE WHEN s = 0 AND ai THEN 'the controller' ELSE '' END AS mismatch FROM r""")
def subject_canonicalisation(spark, d):
    s = F.col("o_orderkey") % 5
    subject = F.when(s == 0, F.array(_one(F.lit("Data controllers")))).when(s == 1, F.array(_one(F.lit("A data record")))).when(s == 2, F.array().cast(_EL)).when(s == 3, F.array(_one(F.lit("Large firms")))).otherwise(F.array(_one(F.lit("any notified bodies"))))
    rows = _statements(_t(spark, d, "orders"), o_orderkey=F.col("o_orderkey"), source=F.when(F.col("o_custkey") % 3 == 0, "aiact").otherwise("gdpr"), text=F.lit("A data record shall without delay be kept, and Large firms keep it."), parents=F.array(F.struct(F.lit("x").alias("iri"), F.lit("nothing").alias("text")), F.struct(F.lit("y").alias("iri"), F.lit("Notified bodies tell the controller that:").alias("text"))), statement_class=F.lit("DEONTIC"), modality=F.element_at(F.array(*map(F.lit, ("OBLIGATION", "PROHIBITION", "PERMISSION", "DISPENSATION"))), (F.col("o_custkey") % 4 + 1).cast("int")), subject=subject, object=F.array(_one(F.lit("tests"))), condition=_one(F.lit("where asked")))
    out = passes.canonicalise_subjects(rows)
    return out.select("o_orderkey", F.col("subject")[0]["value"].alias("subject"), F.array_join(F.transform("object", lambda e: e["value"]), "|").alias("objects"), F.col("condition.value").alias("condition"), F.col("subject_inferred_duty_bearer").alias("inferred"), F.col("subject_unrecognized_actor").alias("unknown"), F.coalesce("subject_vocabulary_mismatch", F.lit("")).alias("mismatch"))


# F9, F34
@_query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Area, of ' || p_name WHEN p_partkey % 4 = 1 THEN 'systems for ' || p_name WHEN p_partkey % 4 = 2 THEN 'AI systems' ELSE 'the Member State law' END AS scope,
  p_partkey % 4 < 2 AS fixed, p_partkey % 4 = 3 AS unverified FROM part WHERE p_partkey % 8 <> 7""")
def scope_passes(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    iri = F.when(k % 4 == 0, "aiact:anx_III/par_3").when(k % 4 == 1, "aiact:anx_III/par_3/pt_b").when(k % 4 == 2, "aiact:anx_III/par_0").otherwise("gdpr:rct_10/p_0")
    text = F.when(k % 4 == 0, F.concat(F.lit("3. Area, of "), name, F.lit(", in so far as it is: used"))).otherwise(F.concat(F.lit("(b) systems for "), name, F.lit(";")))
    scope = F.when(k % 8 == 7, "Its rules").when(k % 4 == 3, "the Member State law").otherwise("AI systems")
    rows = _statements(_t(spark, d, "part"), p_partkey=k, paragraph_iri=iri, unit_type=F.when(k % 4 == 3, "recital").otherwise("annex"), text=text, statement_class=F.lit("APPLICABILITY"), applies_to=_one(scope, "CONTEXT"))
    out = passes.guard_recital_scopes(passes.annex_area(rows))
    return out.select("p_partkey", F.col("applies_to.value").alias("scope"), F.col("annex_area_applies_to_fixed").alias("fixed"), F.col("recital_scope_unverified").alias("unverified"))


# X15, X19, X29-X31, W7, X14
@_query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 4 AS p, c_nationkey % 4 AS m FROM customer)
SELECT k AS c_custkey, p = 0 AND (m = 3 OR k % 2 = 0) AS operator, p = 1 AND m = 1 AS negation, k % 5 < 2 AND k % 5 <> 0 AS smeared,
  CASE WHEN k % 3 = 0 THEN 'compelling legitimate grounds override interests' ELSE '' END AS truncated FROM r""")
def statement_flags(spark, d):
    k = F.col("c_custkey")
    verb = F.element_at(F.array(*map(F.lit, ("prohibit", "no longer process", "notify", "notably keep"))), (k % 4 + 1).cast("int"))
    thing = F.when(k % 2 == 0, "the processing of data").otherwise("the processor")
    text = F.concat(F.lit("1. The controller shall "), verb, F.lit(" "), thing, F.lit(" under Article 6 where he shows "), F.when(k % 3 == 0, "compelling legitimate grounds which override the interests").otherwise("grounds"))
    refs = F.when(k % 5 == 0, F.array(F.lit("gdpr:art_6/par_1"))).when(k % 5 == 1, F.array(F.lit("gdpr:art_9/par_1"))).otherwise(F.array(F.lit("gdpr:art_1/par_1#s2")))
    cited = F.array(*(F.struct(F.lit(i).alias("resolved_iri"), F.lit(s).alias("citation_surface")) for i, s in (("gdpr:art_6/par_1", "Article 6"), ("gdpr:art_9/par_1", "Article 9"))))
    rows = _statements(_t(spark, d, "customer"), c_custkey=k, paragraph_iri=F.concat(F.lit("gdpr:art_1/par_"), k.cast("string")), text=text, cross_references=cited, references=refs, statement_class=F.lit("DEONTIC"), modality=F.element_at(F.array(*map(F.lit, ("OBLIGATION", "PROHIBITION", "PERMISSION", "DISPENSATION"))), (F.col("c_nationkey") % 4 + 1).cast("int")), subject=F.array(_one(F.lit("the controller"))), predicate=F.array(_one(verb)), object=F.array(_one(thing)), anchor=F.lit("under Article 6 shows grounds"))
    # grounds is covered by the anchor, which cuts the run; the words after it are not
    rows = rows.withColumn("anchor", F.when(k % 3 == 0, "under Article 6 shows").otherwise(F.col("anchor")))
    out = passes.flag_redundant_negation(passes.flag_operator_predicates(passes.flag_truncated_spans(passes.flag_smeared_references(rows))))
    return out.select("c_custkey", F.col("predicate_is_deontic_operator").alias("operator"), F.col("predicate_redundant_negation").alias("negation"), F.col("references_unattributed").alias("smeared"), F.coalesce("span_coverage_truncated", F.lit("")).alias("truncated"))


# X1-X3, X9, X11, X17, X35, A1
@_query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'notify ' || p_name WHEN 1 THEN 'erase' WHEN 2 THEN 'is not required to inform' WHEN 3 THEN 'duly take steps' WHEN 4 THEN 'process' ELSE 'not process' END AS predicate,
  p_partkey % 6 IN (2, 5) AS contradicts, lower(p_name) AS plain, 'Regulation (EU) 2016/679' AS cite, CASE WHEN p_partkey % 2 = 0 THEN 'storage ' || p_name ELSE '' END AS tag, 'dpv:' || p_brand AS curie, p_partkey % 2 = 0 AS bare FROM part""")
def text_functions(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.element_at(F.array(F.concat(F.lit("shall have the obligation to notify "), name), F.lit("must be erased"), F.lit("is not required to inform"), F.lit("shall duly take steps"), F.lit("be processing"), F.lit("not process")), (k % 6 + 1).cast("int"))
    n = predicates.normalised(raw, F.lit("OBLIGATION"))
    rows = _t(spark, d, "part").select(k, n.alias("n"), predicates.text_udf(F.concat(F.lit("  The  “"), F.upper(name), F.lit("”;"))).alias("plain"), X.normalise_citation(F.lit("Regulation  (EU) No 2016/679")).alias("cite"), X.defined_terms(F.when(k % 2 == 0, F.concat(F.lit("kept no longer (‘storage "), name, F.lit("’) (x)")))).alias("tags"), X.shorten(F.concat(F.lit("https://w3id.org/dpv#"), "p_brand"), {"pd": "https://w3id.org/dpv/pd#", "dpv": "https://w3id.org/dpv#"}).alias("curie"), X.unconditional(F.when(k % 2 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("if asked")))).alias("bare"))
    return rows.select("p_partkey", F.col("n.text").alias("predicate"), F.col("n.contradiction").alias("contradicts"), F.regexp_replace("plain", '"', "").alias("plain"), "cite", F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("")).alias("tag"), "curie", "bare")


# ---- vocabularies and candidates

_TERMS = """t AS (SELECT 'p' AS vocab, 'x:' || replace(p_name, ' ', '_') AS iri, min(p_name) AS label, split_part(p_name, ' ', 1) AS scheme, split_part(p_name, ' ', 2) AS root FROM part GROUP BY p_name
  UNION ALL SELECT 'v', 'v:process', 'process', 'ops', 'ops' UNION ALL SELECT 'v', 'v:A6-1', 'Art 6', 'legal', 'ops')"""


def _terms(spark, d):
    words = F.split("p_name", " ")
    part = _t(spark, d, "part").select("p_name").distinct().select(F.lit("p").alias("vocab"), F.concat(F.lit("x:"), F.regexp_replace("p_name", " ", "_")).alias("iri"), F.col("p_name").alias("label"), words[0].alias("scheme"), words[1].alias("root"))
    return part.unionByName(spark.createDataFrame([("v", "v:process", "process", "ops", "ops"), ("v", "v:A6-1", "Art 6", "legal", "ops")], part.schema))


_ROUTES = [("predicate", "gdpr", "v", "all", None, 0), ("object", "gdpr", "p", "scheme", "small", 0), ("object", "gdpr", "p", "root", "bolt", 1), ("condition", "gdpr", "v", "root", "ops", 0)]


def _routes(spark):
    return spark.createDataFrame(_ROUTES, "slot string, regulation string, vocab string, by string, value string, sequence int")


_ROUTED = f"""{_TERMS}, r AS (SELECT 'predicate' AS slot, iri, label FROM t WHERE vocab = 'v' UNION ALL SELECT 'object', iri, label FROM t WHERE vocab = 'p' AND (scheme = 'small' OR root = 'bolt')
  UNION ALL SELECT 'condition', iri, label FROM t WHERE vocab = 'v' AND root = 'ops')"""


# F22, F23, A31
@_query(f"""WITH {_ROUTED}, a AS (SELECT * FROM r WHERE iri <> 'x:small_bolt') SELECT slot, 'gdpr' AS regulation, count(*) AS n, count(*) FILTER (iri NOT IN ('v:A6-1') AND iri NOT IN (SELECT iri FROM t WHERE scheme = 'large')) AS adjudicable FROM a GROUP BY slot""")
def routed_vocabulary(spark, d):
    terms = _terms(spark, d)
    labels = candidates.routed(terms, _routes(spark), spark.createDataFrame([("x:small_bolt",)], "iri string"))
    left = candidates.selector_counts(candidates.adjudicable(labels, terms, "large")).withColumnRenamed("n", "adjudicable")
    return candidates.selector_counts(labels).join(left, ["slot", "regulation"], "left").withColumn("adjudicable", F.coalesce("adjudicable", F.lit(0)).cast("long"))


# F24, X16
@_query("""SELECT 'x:' || p_brand AS iri, CASE WHEN p_brand LIKE '%1' THEN lower(p_brand) ELSE 'named' END AS label, p_brand LIKE '%1' AS label_derived FROM (SELECT DISTINCT p_brand FROM part)""")
def own_terms(spark, d):
    terms = _t(spark, d, "part").select(F.concat(F.lit("x:"), "p_brand").alias("iri"), F.when(~F.col("p_brand").endswith("1"), "named").alias("label")).distinct()
    other = terms.withColumn("iri", F.concat(F.lit("y:"), "iri"))
    return candidates.own_terms(terms.union(other), "x:", X.delabel(F.col("iri"))).select("iri", "label", "label_derived")


# M1-M3, M5-M8, T4, F32, X11: values of orders against the routed labels
@_query("""WITH v(k, slot, value) AS (VALUES (0, 'predicate', 'process'), (1, 'predicate', 'handling data'), (2, 'predicate', 'process a claim'), (3, 'predicate', 'store'), (4, 'object', 'the small bolt'), (5, 'object', 'a small bolt of steel'), (6, 'object', 'fasteners'), (7, 'object', 'nothing known'), (8, 'condition', 'if processes end'), (9, 'condition', 'by night')),
w AS (SELECT v.*, 'art_' || (o_custkey % 2) AS article, count(*) AS n FROM orders JOIN v ON v.k = o_orderkey % 10 GROUP BY ALL)
SELECT slot, 'gdpr' AS regulation, value, article, n, CASE WHEN k IN (0, 1, 4, 5, 6) THEN 'mapped' WHEN k IN (7, 8) OR article = 'art_1' THEN 'review' ELSE 'literal' END AS status, k IN (0, 1, 4, 5, 6, 8) AS lexical_hit,
  CASE WHEN k IN (0, 1) THEN 'v:process' WHEN k IN (4, 5, 6) THEN 'x:small_bolt' ELSE '' END AS iri,
  CASE k WHEN 0 THEN 'exact:v:process' WHEN 1 THEN 'synonym:v:process' WHEN 4 THEN 'exact:x:small_bolt' WHEN 5 THEN 'lexical:x:small_bolt' WHEN 6 THEN 'alias:x:small_bolt' WHEN 7 THEN '' WHEN 8 THEN 'lexical:v:process'
    ELSE CASE WHEN article = 'art_1' THEN 'tag:v:process' ELSE '' END END AS shown FROM w""")
def candidate_worksheet(spark, d):
    values = ["process", "handling data", "process a claim", "store", "the small bolt", "a small bolt of steel", "fasteners", "nothing known", "if processes end", "by night"]
    slots = ["predicate"] * 4 + ["object"] * 4 + ["condition"] * 2
    at = (F.col("o_orderkey") % 10 + 1).cast("int")
    rows = _t(spark, d, "orders").select(F.element_at(F.array(*map(F.lit, slots)), at).alias("slot"), F.lit("gdpr").alias("regulation"), F.element_at(F.array(*map(F.lit, values)), at).alias("value"), F.concat(F.lit("art_"), (F.col("o_custkey") % 2).cast("string")).alias("article"))
    vals = rows.groupBy("slot", "regulation", "value", "article").agg(F.count("*").alias("n")).withColumn("paragraphs", F.array(F.concat("article", F.lit("/par_1"))))
    labels = candidates.routed(_terms(spark, d), _routes(spark))
    synonyms = spark.createDataFrame([("handle", "v:process"), ("handle", "v:unknown")], "verb string, iri string")
    aliases = spark.createDataFrame([("fastener", "x:small_bolt"), ("fastener", "x:unknown")], "phrase string, iri string")
    tags = spark.createDataFrame([("art_1/par_1", "process"), ("art_1/par_1", "of the")], "paragraph string, tag string")
    out = candidates.worksheet(vals, labels, synonyms, aliases, tags)
    return out.select("slot", "regulation", "value", "article", "n", "status", "lexical_hit", F.array_join("iri", ",").alias("iri"), F.array_join("candidates", ",").alias("shown"))


# M9: the nearest labels of vectors, by label classes as routes
@_query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id % 50 = 0 AS q FROM embeddings),
s AS (SELECT a.vec_id AS value, b.vec_id AS iri, round(list_dot_product(a.e, b.e), 3) AS score FROM v a JOIN v b ON a.label = b.label AND a.q AND NOT b.q)
SELECT value, 'e' || iri AS iri, score, row_number() OVER (PARTITION BY value ORDER BY score DESC, 'e' || iri)::INT AS rank FROM s QUALIFY rank <= 6""")
def nearest_labels(spark, d):
    v = _t(spark, d, "embeddings").withColumns({"slot": F.lit("object"), "regulation": F.col("label").cast("string")})
    queries = v.where("vec_id % 50 = 0").select("slot", "regulation", F.col("vec_id").alias("value"), F.col("embedding").alias("vector"))
    labels = v.where("vec_id % 50 <> 0").select("slot", "regulation", F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("iri"), F.col("embedding").alias("vector"))
    return candidates.nearest_matches(queries, labels, 6).select("value", "iri", "score", "rank")


# ---- models: answers by rule stand in for a language model


class _Rules:
    """Answers prompts by rule, so that runs need no model: what is asked is in the prompt's own words."""

    def __call__(self, prompt: str) -> str:
        last = prompt.split("\n")[-1]
        if "AUTOMOBILE" in prompt and "Not allowed" not in prompt:
            return json.dumps({"keep": False, "justification": "cars", "iri": ["x:unknown"], "disposition": "mapped", "confidence": 0.9, "verdict": "COMPLIANT", "explanation": last, "cited": ["c"]})
        if "FURNITURE" in prompt:
            return "no JSON"
        if "BUILDING" in prompt:
            raise ValueError("refused")
        low = "HOUSEHOLD" in prompt
        return json.dumps({"keep": True, "justification": "kept", "iri": [] if "MACHINERY" in prompt else ["x:known"], "disposition": "mapped", "confidence": 0.5 if low else 0.9, "verdict": "INSUFFICIENT" if low else "MAYBE", "explanation": last, "cited": []})


# F2, UD1, UD2, F31
@_query("""SELECT c_custkey, c_mktsegment <> 'AUTOMOBILE' AS screen_keep, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cars' WHEN 'FURNITURE' THEN 'the answer is not of the schema' WHEN 'BUILDING' THEN 'ValueError: refused' ELSE 'kept' END AS screen_justification FROM customer""")
def model_screen(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.lit(None).cast("string").alias("parent_text"), F.col("c_mktsegment").alias("text"))
    return extract.screen(rows, _Rules()).select("c_custkey", "screen_keep", "screen_justification")


# UD5: a choice that isn't allowed is asked for once more
@_query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'x:known' WHEN c_mktsegment IN ('FURNITURE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN '' ELSE 'x:known' END AS iri,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'escalated' WHEN 'BUILDING' THEN 'escalated' WHEN 'HOUSEHOLD' THEN 'escalated' WHEN 'MACHINERY' THEN 'literal' ELSE 'mapped' END AS disposition,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE', 'BUILDING') THEN 2 ELSE 1 END::INT AS attempts FROM customer""")
def adjudication_retry(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.lit("object").alias("slot"), "c_mktsegment")
    allowed = spark.createDataFrame([("object", "x:known"), ("predicate", "x:unknown")], "slot string, iri string")
    out = extract.adjudicate(rows, allowed, _Rules(), F.concat(F.lit("choose for "), F.col("c_custkey").cast("string"), F.lit("\n"), F.col("c_mktsegment")), ["slot"])
    return out.select("c_custkey", F.array_join("iri", ",").alias("iri"), "disposition", "attempts")


# X22
@_query("""SELECT 'all' AS slot, string_agg('[' || s || ']' || chr(10) || lines, chr(10) ORDER BY s) AS vocabulary FROM (SELECT split_part(p_name, ' ', 1) AS s, string_agg('  x:' || replace(p_name, ' ', '_') || ' (' || p_name || ')', chr(10) ORDER BY '  x:' || replace(p_name, ' ', '_')) AS lines FROM (SELECT DISTINCT p_name FROM part) GROUP BY s)""")
def vocabulary_prompt(spark, d):
    return extract.vocabulary_lines(_terms(spark, d).where("vocab = 'p'").withColumn("slot", F.lit("all")), ["slot"])


# ---- answering


_ASKED = """st AS (SELECT 'gdpr:art_' || c_custkey || '/par_1#s1' AS id, 'gdpr:art_' || c_custkey || '/par_1' AS provision, c_acctbal > 0 AS verified FROM customer),
eg AS (SELECT DISTINCT 'gdpr:art_' || o_custkey || '/par_1#s1' AS src, CASE o_orderkey % 3 WHEN 0 THEN 'REFERS_TO' WHEN 1 THEN 'EXCEPTION_OF' ELSE 'SPECIALISES' END AS rel, 'gdpr:art_' || (o_custkey * 3 % 140 + 1) || '/par_1#s1' AS dst FROM orders),
qs AS (SELECT n_nationkey AS query_id, 'gdpr:art_' || (n_nationkey + 1) AS prefix FROM nation),
sd AS (SELECT query_id, id FROM (SELECT query_id, st.id, row_number() OVER (PARTITION BY query_id ORDER BY st.id) AS place FROM qs JOIN st ON st.verified AND starts_with(st.provision, qs.prefix)) WHERE place <= 100),
bo AS (SELECT src AS id, dst AS other FROM eg WHERE rel <> 'SPECIALISES' UNION SELECT dst, src FROM eg WHERE rel <> 'SPECIALISES'),
nd AS (SELECT query_id, id FROM sd UNION SELECT query_id, bo.other FROM sd JOIN bo USING (id) JOIN st ON st.id = bo.other AND st.verified)"""


def _graph(spark, d):
    c = _t(spark, d, "customer")
    provision = F.concat(F.lit("gdpr:art_"), F.col("c_custkey").cast("string"), F.lit("/par_1"))
    statements = c.select(F.concat(provision, F.lit("#s1")).alias("id"), (F.col("c_acctbal") > 0).alias("verified"), F.lit("DEONTIC").alias("statement_class"), provision.alias("source_article"), F.lit("OBLIGATION").alias("modality"), *(F.lit(None).cast("string").alias(k) for k in ("term", "definition", "scope_type", "polarity", "applies_to")), F.array(F.lit("That record:")).alias("parent_texts"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("anchor"), F.concat(F.lit("par of "), "c_name").alias("paragraph_text"))
    sources = c.select(F.concat(provision, F.lit("#s1")).alias("id"), provision.alias("provision"))
    o = _t(spark, d, "orders")
    sid = lambda k: F.concat(F.lit("gdpr:art_"), k.cast("string"), F.lit("/par_1#s1"))
    rel = F.when(F.col("o_orderkey") % 3 == 0, "REFERS_TO").when(F.col("o_orderkey") % 3 == 1, "EXCEPTION_OF").otherwise("SPECIALISES")
    edges = o.select(sid(F.col("o_custkey")).alias("src"), rel.alias("rel"), sid(F.col("o_custkey") * 3 % 140 + 1).alias("dst")).distinct()
    prefixes = _t(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("gdpr:art_"), (F.col("n_nationkey") + 1).cast("string")).alias("prefix"))
    return statements, sources, edges, prefixes


# F14, F28, T3, J15, SRC15: seeds by raw prefixes, of verified statements
@_query(f"WITH {_ASKED} SELECT * FROM sd")
def seeds_by_prefix(spark, d):
    statements, sources, _, prefixes = _graph(spark, d)
    return answer.seeds_below(statements, sources, prefixes)


# J24, U1
@_query(f"WITH {_ASKED} SELECT * FROM nd")
def expanded_nodes(spark, d):
    statements, sources, edges, prefixes = _graph(spark, d)
    return answer.expanded(answer.seeds_below(statements, sources, prefixes), edges, statements)


# J25, X21, UD9: what a model reads
@_query(f"""WITH {_ASKED}, b AS (SELECT query_id, string_agg('[' || nd.id || '] DEONTIC' || chr(10) || '  source: ' || st.provision || chr(10) || '  modality: OBLIGATION' || chr(10) || '  context: "That record:"' || chr(10) || '  text: "' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'par of ' || c_name END || '"', chr(10) || chr(10) ORDER BY nd.id) AS statements
  FROM nd JOIN st ON st.id = nd.id JOIN customer ON st.provision = 'gdpr:art_' || c_custkey || '/par_1' GROUP BY query_id),
x AS (SELECT a.query_id, string_agg(src || ' ' || rel || ' ' || dst, chr(10) ORDER BY src, rel, dst) AS edges FROM eg JOIN nd a ON a.id = src JOIN nd b ON b.query_id = a.query_id AND b.id = dst GROUP BY a.query_id)
SELECT b.query_id, md5(statements) AS statements, md5(coalesce(edges, '(none)')) AS edges, CASE WHEN b.query_id % 2 = 0 THEN '[p] some text' ELSE '(none)' END AS snippets FROM b LEFT JOIN x ON x.query_id = b.query_id""")
def answer_contexts(spark, d):
    statements, sources, edges, prefixes = _graph(spark, d)
    nodes = answer.expanded(answer.seeds_below(statements, sources, prefixes), edges, statements)
    snippets = prefixes.where("query_id % 2 = 0").select("query_id", F.lit("p").alias("provision"), F.lit("some text").alias("text"), F.lit(1).alias("rank"))
    out = answer.contexts(nodes, statements, edges, snippets.join(nodes.select("query_id").distinct(), "query_id"))
    return out.select("query_id", F.md5("statements").alias("statements"), F.md5("edges").alias("edges"), "snippets")


_NEAR = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, CASE WHEN vec_id % 3 = 0 THEN 'gdpr:rct_' ELSE 'gdpr:art_' END || vec_id AS provision FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS x FROM v WHERE vec_id % 50 = 0),
r AS (SELECT query_id, provision, round(list_dot_product(x, e), 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(x, e), 5) DESC, provision) AS rank FROM q JOIN v ON true)"""


def _near(spark, d):
    v = _t(spark, d, "embeddings")
    provision = F.concat(F.when(F.col("vec_id") % 3 == 0, "gdpr:rct_").otherwise("gdpr:art_"), F.col("vec_id").cast("string"))
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("q")), v.select(provision.alias("provision"), "embedding")


# recitals go after the first look, not before
@_query(f"""WITH {_NEAR} SELECT * FROM (SELECT query_id::VARCHAR AS query_id, provision, row_number() OVER (PARTITION BY query_id ORDER BY r.rank)::INT AS rank FROM r WHERE r.rank <= 24 AND provision NOT LIKE '%rct%') WHERE rank <= 8""")
def dense_seeds(spark, d):
    return answer.dense_provisions(*_near(spark, d))


# the covered list is narrowed where it is long
@_query(f"WITH {_NEAR} SELECT query_id::VARCHAR AS query_id, provision FROM r WHERE rank <= 50")
def narrowed_provisions(spark, d):
    return answer.shown_provisions(*_near(spark, d))


# The first way that gives seeds
@_query(f"""WITH {_NEAR}, t AS (SELECT query_id, provision AS id, 'template' AS seed_path FROM q JOIN v ON query_id % 100 = 0 AND provision = 'gdpr:art_' || (query_id + 1)),
g AS (SELECT query_id, 'generated' AS id, 'llm_query' AS seed_path FROM q WHERE query_id % 150 = 0 AND query_id NOT IN (SELECT query_id FROM t)),
n AS (SELECT DISTINCT r.query_id, v.provision AS id, 'vector_fallback' AS seed_path FROM r JOIN v ON starts_with(v.provision, r.provision) WHERE rank <= 3 AND r.query_id NOT IN (SELECT query_id FROM t) AND r.query_id NOT IN (SELECT query_id FROM g))
SELECT query_id::VARCHAR AS query_id, seed_path, id FROM (SELECT * FROM t UNION ALL SELECT query_id, id, seed_path FROM g UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 100""")
def seed_selection(spark, d):
    questions, vectors = _near(spark, d)
    at = F.col("query_id").cast("long")
    statements = vectors.select(F.col("provision").alias("id"), F.lit(True).alias("verified"))
    sources = vectors.select(F.col("provision").alias("id"), "provision")
    named = F.when(at % 100 == 0, F.array(F.concat(F.lit("gdpr:art_"), (at + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    intents = questions.select("query_id", named.alias("target_provisions"))
    generated = questions.where(at % 150 == 0).select("query_id", F.lit("generated").alias("id"))
    # the exact provision is wanted; a raw prefix would also meet longer numbers
    return answer.choose_seeds(intents, statements, sources, questions, vectors, generated, bounded=True)


# M12, SNK5: verdicts, those that can't be given apart
@_query("""SELECT c_custkey AS query_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'COMPLIANT' WHEN 'HOUSEHOLD' THEN 'INSUFFICIENT' ELSE '' END AS label, c_mktsegment = 'HOUSEHOLD' AS review, c_mktsegment IN ('FURNITURE', 'BUILDING') AS failed FROM customer""")
def verdicts(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Is it so? "), "c_mktsegment").alias("question"))
    out = answer.baseline(rows, rows.where("false").select("query_id", F.lit("").alias("provision"), F.lit("").alias("text"), F.lit(1).alias("rank")), _Rules())
    queue = answer.to_review(out).select("query_id", F.lit(True).alias("review"))
    return out.join(queue, "query_id", "left").select("query_id", F.coalesce("verdict.verdict", F.lit("")).alias("label"), F.coalesce("review", F.lit(False)).alias("review"), F.col("verdict_error").isNotNull().alias("failed"))


# ---- graph records


# F25-F27, F21
@_query("""SELECT c_custkey::VARCHAR AS statement_id, CASE WHEN c_custkey % 3 = 0 THEN 'low_groundedness,truncated' WHEN c_custkey % 3 = 1 THEN 'truncated' ELSE '' END AS flags, c_nationkey % 3 = 0 AS is_llm_suggested, c_nationkey % 3 = 1 AS is_human_reviewed,
  c_mktsegment AS object_text FROM customer WHERE c_custkey % 5 <> 0""")
def statement_nodes(spark, d):
    return graph.statement_nodes(_mapped(spark, d), {"object": "HAS_OBJECT"}, ("truncated", "low_groundedness")).select("statement_id", F.array_join("flags", ",").alias("flags"), "is_llm_suggested", "is_human_reviewed", F.array_join("object_text", "|").alias("object_text"))


def _mapped(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    status = F.when(n % 3 == 0, "llm_suggested_mapped").when(n % 3 == 1, "manually_mapped").otherwise("mapped")
    iri = F.when(k % 2 == 0, F.array(F.lit("x:a"), F.lit("x:b"))).otherwise(F.array().cast("array<string>"))
    element = F.struct(F.col("c_mktsegment").alias("value"), F.lit("STATED").alias("method"), iri.alias("iri"), status.alias("mapping_status"))
    refs = F.array(F.concat(F.lit("gdpr:art_"), n.cast("string")), F.concat(F.lit("gdpr:art_"), n.cast("string"), F.lit("#s1")))
    return _t(spark, d, "customer").select(k.cast("string").alias("statement_id"), F.when(k % 5 == 0, "NOT_APPLICABLE").otherwise("DEONTIC").alias("statement_class"), F.lit("OBLIGATION").alias("modality"), F.concat(F.lit("gdpr:art_"), n.cast("string")).alias("paragraph_iri"), F.array(element).alias("object"), refs.alias("references"), F.lit(True).alias("t"), (k % 3 < 2).alias("truncated"), (k % 3 == 0).alias("low_groundedness"))


# F26
@_query("""SELECT c_custkey::VARCHAR AS src, 'gdpr:art_' || c_nationkey || t AS dst, CASE t WHEN '' THEN 'provision' ELSE 'statement' END AS kind FROM customer, (VALUES (''), ('#s1')) AS x(t) WHERE c_custkey % 5 <> 0""")
def reference_edges(spark, d):
    return graph.reference_edges(_mapped(spark, d))


# F25, SNK2
@_query("""SELECT c_custkey::VARCHAR AS statement_id, 'HAS_OBJECT' AS rel, c_mktsegment AS value, i AS iri FROM customer, (VALUES ('x:a'), ('x:b')) AS x(i) WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'HAS_OBJECT', c_mktsegment, 'none' FROM customer WHERE c_custkey % 2 = 1""")
def slot_edges(spark, d):
    out = graph.slot_edges(_mapped(spark, d), {"object": "HAS_OBJECT"})
    return out.select("statement_id", "rel", "value", F.coalesce("iri", F.lit("none")).alias("iri"))


# SNK2: later rows over earlier ones, and values over nulls
@_query("""SELECT c_custkey, coalesce(CASE WHEN o.last IS NOT NULL AND o.last % 2 = 0 THEN 'order ' || o.last END, c_name) AS text, o.last AS last FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def keyed_upsert(spark, d):
    k = F.col("o_orderkey")
    rows = graph.last_by_key(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), k.alias("last"), F.when(k % 2 == 0, F.concat(F.lit("order "), k.cast("string"))).alias("text")), ["c_custkey"], "last")
    return graph.upsert(_t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("text")), rows, ["c_custkey"]).select("c_custkey", "text", "last")


# J13, J14
@_query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'had' WHEN n_nationkey < 10 THEN 'filled' ELSE 'missing' END AS backfill, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN n_nationkey < 10 THEN n_name ELSE '' END AS text FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def backfilled_text(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("paragraph_iri"), F.when(F.col("c_custkey") % 3 == 0, "own").when(F.col("c_custkey") % 3 == 1, "").alias("paragraph_text"))
    known = _t(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("iri"), F.col("n_name").alias("text"))
    return extract.backfill(rows, known).select("c_custkey", "backfill", F.coalesce("paragraph_text", F.lit("")).alias("text"))


# R6, X18, F11, F30
@_query("""SELECT c_custkey::VARCHAR AS statement_id, 'The firm shall not pay ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', where asked' ELSE '' END || '.' AS sentence,
  CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS stated, c_custkey % 4 = 1 AS ungrounded, c_custkey % 2 = 1 AS blank FROM customer""")
def statement_sentences(spark, d):
    k = F.col("c_custkey")
    condition = F.when(k % 2 == 0, _one(F.lit("asked"))).otherwise(_one(F.lit(" "), "NONE"))
    predicate = F.when(k % 4 == 1, F.array(_one(F.lit("pay"), "CITATION"))).otherwise(F.array(_one(F.lit("pay"))))
    rows = _statements(_t(spark, d, "customer"), statement_id=k.cast("string"), statement_class=F.lit("DEONTIC"), modality=F.lit("PROHIBITION"), subject=F.array(_one(F.lit("the firm"), "CONTEXT")), predicate=predicate, object=F.array(_one(F.col("c_mktsegment"))), condition=condition)
    stated = extract.stated_values(rows).groupBy("statement_id").agg(F.count("*").alias("n"))
    flags = rows.select("statement_id", passes.ungrounded(rows).alias("ungrounded"), passes.blank_slots(rows).alias("blank"))
    out = extract.sentences(rows).join(stated, "statement_id").join(flags, "statement_id")
    return out.select("statement_id", "sentence", (F.col("n") + F.when(F.col("ungrounded"), 1).otherwise(0)).alias("stated"), "ungrounded", "blank")


# ---- evaluation


# Orders as gold records and as a run that differs in places
@_query("""WITH g AS (SELECT o_orderkey AS k, o_orderkey % 6 AS s FROM orders WHERE o_orderkey % 17 <> 0)
SELECT 'g' || k AS gold_id, 'DEONTIC' AS class, CASE WHEN s = 1 THEN 'modality' WHEN s = 2 THEN 'needs_review' ELSE '' END AS hard,
  CASE s WHEN 3 THEN 'object,references' WHEN 4 THEN 'predicate' ELSE '' END AS soft, CASE WHEN s IN (1, 2) THEN 'hard' ELSE 'clean' END AS bucket FROM g""")
def compare_fields(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderkey") % 6
    rows = _t(spark, d, "orders")
    element = lambda v: F.array(_one(v))
    base = lambda p, m, v, o, refs, review: rows.select(F.concat(F.lit(p), k.cast("string")).alias("statement_id"), F.lit("DEONTIC").alias("statement_class"), m.alias("modality"), F.lit("a").alias("source_article"), refs.alias("references"), element(F.lit("the firm")).alias("subject"), element(v).alias("predicate"), element(o).alias("object"), _one(F.lit("If asked.")).alias("condition"), review.alias("needs_review"), (k % 17 == 0).alias("screen_dependent"))
    ref = lambda p: F.array(F.lit("gdpr:art_6"), F.concat(F.lit(p), k.cast("string")))
    gold_rows = base("g", F.lit("OBLIGATION"), F.lit("notify"), F.lit("The board"), ref("g"), F.when(s == 2, True))
    run_refs = F.when(s == 3, F.array(F.lit("gdpr:art_7"))).otherwise(F.array(F.concat(F.lit("r"), k.cast("string")), F.lit("gdpr:art_6/par_1")))
    run_rows = base("r", F.when(s == 1, "PERMISSION").otherwise("OBLIGATION"), F.when(s == 4, "inform").otherwise("shall notify"), F.when(s == 3, "a body").otherwise("board"), run_refs, F.lit(False))
    kept = gold.scored_gold(gold_rows)
    pairs = kept.select(F.col("statement_id").alias("gold_id"), F.concat(F.lit("r"), F.substr("statement_id", F.lit(2))).alias("run_id"))
    out = gold.compare(pairs, gold.canonical(kept), gold.canonical(run_rows))
    return out.select("gold_id", "class", F.array_join("hard", ",").alias("hard"), F.array_join("soft", ",").alias("soft"), "bucket")


# A26
@_query("""WITH r AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'x' ELSE 'y' END AS check_name, ['a', 'b', 'none'][c_custkey % 3 + 1] AS verdict, ['a', 'none', '', 'b'][c_nationkey % 4 + 1] AS label FROM customer),
l AS (SELECT * FROM r WHERE label <> ''), k AS (SELECT DISTINCT check_name, c FROM (SELECT check_name, unnest([verdict, label]) AS c FROM l) WHERE c <> 'none')
SELECT k.check_name, c AS class, count(*) FILTER (verdict = c AND label = c) AS tp, count(*) FILTER (verdict = c AND label <> c) AS fp, count(*) FILTER (verdict <> c AND label = c) AS fn,
  round(count(*) FILTER (verdict = c AND label = c) / nullif(count(*) FILTER (verdict = c), 0), 6) AS precision, round(count(*) FILTER (verdict = c AND label = c) / nullif(count(*) FILTER (label = c), 0), 6) AS recall FROM k JOIN l ON l.check_name = k.check_name GROUP BY k.check_name, c""")
def detector_scores(spark, d):
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    rows = _t(spark, d, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "x").otherwise("y").alias("check_name"), pick(["a", "b", "none"], F.col("c_custkey") % 3).alias("verdict"), pick(["a", "none", "", "b"], F.col("c_nationkey") % 4).alias("label"))
    return evaluate.detector_scores(rows)


# A24
@_query("""WITH r AS (SELECT c_mktsegment AS class, c_custkey % 3 + 1 AS attempts, c_nationkey % 5 <> 0 AS valid, c_custkey % 7 = 0 AS blank FROM customer)
SELECT coalesce(class, 'all') AS class, count(*) AS n, round(count(*) FILTER (attempts = 1 AND valid) / count(*), 6) AS first_attempt, round(count(*) FILTER (valid) / count(*), 6) AS revalidated, round(count(*) FILTER (NOT blank) / count(*), 6) AS complete FROM r GROUP BY GROUPING SETS ((class), ())""")
def schema_validity(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("class"), (F.col("c_custkey") % 3 + 1).alias("attempts"), (F.col("c_nationkey") % 5 != 0).alias("valid"), (F.col("c_custkey") % 7 == 0).alias("blank"))
    return evaluate.validity(rows)


# A21, A22
@_query("""WITH w AS (SELECT l_partkey AS slot, l_suppkey AS run, min(l_returnflag) AS value FROM lineitem GROUP BY ALL), g AS (SELECT slot, count(*) AS runs, count(DISTINCT value) AS forms FROM w GROUP BY slot HAVING count(*) >= 2),
b AS (SELECT 'flag' AS field, count(*) FILTER (forms > 1) / count(*) AS base FROM g), r AS (SELECT 'flag' AS field, l_returnflag <> CASE WHEN l_orderkey % 10 = 0 THEN 'Z' ELSE l_returnflag END AS d FROM lineitem UNION ALL SELECT 'status', l_orderkey % 20 = 0 FROM lineitem)
SELECT r.field, count(*) AS compared, count(*) FILTER (d) AS drifted, round(count(*) FILTER (d) / count(*), 6) AS rate, round(count(*) FILTER (d) / count(*) - coalesce(any_value(base), 0), 6) AS excess, count(*) FILTER (d) / count(*) - coalesce(any_value(base), 0) > 1e-9 AS drifts FROM r LEFT JOIN b ON b.field = r.field GROUP BY r.field""")
def field_drift(spark, d):
    lines = _t(spark, d, "lineitem")
    by_slot = lines.select("l_partkey", "l_suppkey", "l_returnflag").repartition(storage.parts(spark, lines.count()), "l_partkey")
    base = evaluate.wobble(by_slot.groupBy(F.col("l_partkey").alias("slot"), F.col("l_suppkey").alias("run")).agg(F.min("l_returnflag").alias("value")).withColumn("field", F.lit("flag")))
    k = F.col("l_orderkey")
    flag = lines.select(F.lit("flag").alias("field"), F.col("l_returnflag").alias("before"), F.when(k % 10 == 0, "Z").otherwise(F.col("l_returnflag")).alias("after"))
    status = lines.select(F.lit("status").alias("field"), F.col("l_linestatus").alias("before"), F.when(k % 20 == 0, "Z").otherwise(F.col("l_linestatus")).alias("after"))
    return evaluate.drift(flag.union(status), base)


# A19
@_query("""WITH r AS (SELECT o_orderstatus AS p, o_orderkey % 4 AS n FROM orders) SELECT 'seed_path' AS kind, p AS label, count(*) AS n FROM r GROUP BY p
UNION ALL SELECT 'attempt', a || ':' || CASE WHEN a = n AND p = 'F' THEN 'ok' ELSE 'error' END, count(*) FROM r JOIN (VALUES (1), (2), (3)) AS x(a) ON a <= n GROUP BY ALL UNION ALL SELECT 'with_attempts', '', count(*) FROM r WHERE n > 0""")
def loop_statistics(spark, d):
    n = (F.col("o_orderkey") % 4).cast("int")
    attempts = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda a: F.struct(a.alias("attempt"), F.when(~((a == n) & (F.col("o_orderstatus") == "F")), "failed").alias("error")))).otherwise(F.array().cast("array<struct<attempt:int,error:string>>"))
    return evaluate.loop_statistics(_t(spark, d, "orders").select(F.col("o_orderstatus").alias("seed_path"), attempts.alias("attempts")))


# A33
@_query("""SELECT count(*) AS answers, round(avg(CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE (o_orderkey % 3 + 1) / (o_orderkey % 3 + 2.0) END), 6) AS faithfulness, round(min(CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE (o_orderkey % 3 + 1) / (o_orderkey % 3 + 2.0) END), 6) AS least_faithful,
  round(avg((0.5 + (o_custkey % 10) / 20.0) * 1.0), 6) AS relevance FROM orders""")
def live_means(spark, d):
    k = F.col("o_orderkey")
    s = 0.5 + (F.col("o_custkey") % 10) / 20.0
    return evaluate.live_means(_t(spark, d, "orders").select(F.when(k % 5 == 0, 0).otherwise(k % 3 + 1).alias("supported"), F.when(k % 5 == 0, 0).otherwise(k % 3 + 2).alias("claims"), F.array(s, s, s).alias("similarities")))


# Paraphrases have the gold of their base
@_query("""WITH r AS (SELECT c_custkey AS q, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 3 ELSE c_custkey END AS base, c_nationkey % 4 AS v FROM customer), b AS (SELECT r.*, g.c_nationkey % 4 AS gold FROM r JOIN customer g ON g.c_custkey = r.base)
SELECT subset, asked, agreed, round(max(agreed / asked) OVER () - min(agreed / asked) OVER (), 6) AS spread FROM (SELECT CASE WHEN q % 3 = 0 THEN 'paraphrase' ELSE 'base' END AS subset, count(*) AS asked, count(*) FILTER (v = gold) AS agreed FROM b GROUP BY 1)""")
def paraphrase_adherence(spark, d):
    k = F.col("c_custkey")
    c = _t(spark, d, "customer")
    results = c.select(k.alias("query_id"), (F.col("c_nationkey") % 4).alias("verdict"))
    of = c.where(k % 3 == 0).select(k.alias("query_id"), F.floor(k / 3).alias("paraphrase_of"))
    truth = c.select(k.alias("query_id"), (F.col("c_nationkey") % 4).alias("gold"))
    out = evaluate.resolve_paraphrases(results, of, truth)
    return evaluate.subset_adherence(out.select(F.when(F.col("query_id") % 3 == 0, "paraphrase").otherwise("base").alias("subset"), (F.col("verdict") == F.col("gold")).alias("adheres")))


# J30
@_query("""SELECT CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 5 = 1 THEN 'skipped' WHEN c_custkey % 5 = 2 THEN 'differs' ELSE 'agrees' END AS outcome, count(*) AS n FROM customer GROUP BY 1""")
def judged_predictions(spark, d):
    k = F.col("c_custkey")
    c = _t(spark, d, "customer")
    truth = c.select(k, F.col("c_nationkey"), F.array(F.lit("x:b"), F.lit("x:a")).alias("iri"))
    said = c.where(k % 5 != 0).select(k, "c_nationkey", F.when(k % 5 == 2, F.array(F.lit("x:a"))).otherwise(F.array(F.lit("x:a"), F.lit("x:b"))).alias("iri"), (k % 5 != 1).alias("adjudicated"))
    return evaluate.judged_predictions(said, truth, ["c_custkey", "c_nationkey"])
