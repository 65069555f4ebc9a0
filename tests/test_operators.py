"""Operators without SQL, on small fixtures."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import predicates, roles, text
from tessella.operators import answer, extract, gold, graph, matching, models, passes, retrieve, sqlguard, structure, verify, xref
from tessella.sources import files, html


def test_predicates(spark):
    cases = [("shall have the obligation to erase", "OBLIGATION", "erase", False), ("is not required to inform", "DISPENSATION", "inform", False), ("is not required to inform", "OBLIGATION", "is not required to inform", True), ("refrain from requesting", "PROHIBITION", "request", False), ("take reasonable steps to inform", "OBLIGATION", "take reasonable steps to inform", False), ("can't be erased", "OBLIGATION", "can't be erased", False), ("being further processed, in part", "PERMISSION", "further process, in part", False), ("No Longer keeping", "PROHIBITION", "No Longer keep", False), (None, None, None, False), ("  ", None, "  ", False)]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, t string, m string")
    got = df.select("i", predicates.normalised(F.col("t"), F.col("m")).alias("n")).orderBy("i").collect()
    assert [(r.n.text, r.n.contradiction) for r in got] == [c[2:] for c in cases]
    assert predicates.normalise_text(" The “Data  subject”; ") == '"data subject"'
    assert predicates.normalise_text(None) == ""
    assert spark.range(1).select(text.plain_form(F.lit(" The “Data  subject”; "))).first()[0] == '"data subject"'
    verbs = {"taken": "take", "applies": "apply", "stopped": "stop", "processes": "process", "made": "make", "notified": "notify", "requesting": "request", "ensures": "ensure", "using": "use"}
    df = spark.createDataFrame(list(verbs.items()), "a string, b string")
    assert df.where(predicates.lemma(F.col("a")) != F.col("b")).collect() == []


def test_columns(spark):
    df = spark.createDataFrame([("1. One",), ("(iv) four",), ("(16) it",), ("(b) bee",), ("none",), (None,)], "t string")
    got = [tuple(r) for r in df.select(text.leading_marker(F.col("t")), text.marker_segment(text.leading_marker(F.col("t")))).collect()]
    assert got == [("1.", "par_1"), ("(iv)", "pt_iv"), ("(16)", "par_16"), ("(b)", "pt_b"), (None, None), (None, None)]
    assert spark.range(1).select(text.delabel(F.lit("dpv:LegalBasisGDPR_x"))).first()[0] == "legal basis gdpr x"
    assert spark.range(1).select(text.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))).first()[0] == 0.5


def test_paragraphs(spark):
    page = """<nav><p class="oj-normal">skip</p></nav><div id="cpt_I"><div class="eli-subdivision" id="art_5"><div class="eli-title"><p class="oj-normal">skip</p></div><p class="oj-ti-art">Article 5</p><p class="oj-sti-art">Principles</p>
    <p class="oj-normal">1. Data shall be:<br>really:</p><table><tr><td>(a)</td><td><p class="oj-normal">kept fairly:</p><table><tbody><tr><td>(i)</td><td><p class="oj-normal">deep</p></td></tr></tbody></table></td></tr></table>
    <div id="005.002"><p class="oj-normal">(2)</p><p class="oj-normal">2. Next.</p><table><tr><td>x</td></tr><tr><td>(b)</td><td></td></tr></table></div></div></div>
    <div class="eli-container" id="anx_IV"><p class="oj-doc-ti">ANNEX IV</p><p class="oj-doc-ti">Documents</p><p class="oj-normal">one</p></div><div class="eli-subdivision" id="other"><p class="oj-normal">skip</p></div>"""
    got = html.paragraphs(spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string"), "id", "html").collect()
    lead = "1. Data shall be: really:"
    assert [(r.id, r.unit_id, r.unit_type, r.heading, r.chapter, r.paragraph_index, r.text, r.parent_text) for r in got] == [
        (1, "art_5", "article", "Principles", "I", 0, lead, None), (1, "art_5", "article", "Principles", "I", 1, "(a) kept fairly:", lead), (1, "art_5", "article", "Principles", "I", 2, "(i) deep", f"{lead}\n(a) kept fairly:"),
        (1, "art_5", "article", "Principles", "I", 3, "2. Next.", None), (1, "art_5", "article", "Principles", "I", 4, "(b)", None), (1, "anx_IV", "annex", "Documents", None, 0, "one", None)]


PARAGRAPHS = "source string, unit_id string, unit_type string, paragraph_index int, text string, parent_text string"


def minted(spark, rows, unit="art_5", kind="article"):
    df = spark.createDataFrame([("x", unit, kind, i, *r) for i, r in enumerate(rows)], PARAGRAPHS)
    return [r.iri.split("/", 1)[1] for r in structure.mint_identifiers(df).orderBy("paragraph_index").collect()]


def test_identifiers(spark):
    lead = "1. Data shall be:"
    assert minted(spark, [(lead, None), ("(a) fair;", lead), ("tail of a", lead), ("2. Two", None), ("more of two", None)]) == ["par_1", "par_1/pt_a", "par_1/cont_1", "par_2", "par_2/cont_1"]


def test_identifiers_follow_the_last_of_equal_lead_ins(spark):
    # a lead-in that comes again later is looked up there, where nothing has a path yet
    assert minted(spark, [("(a) items:", None), ("(i) x", "(a) items:"), ("(b) y", None), ("(a) items:", None)])[:2] == ["p_0", "p_1"]
    assert minted(spark, [("1. One:", None), ("(a) items:", "1. One:"), ("(i) x", "1. One:\n(a) items:"), ("2. Two:", None), ("(a) items:", "2. Two:")]) == ["par_1", "par_1/pt_a", "par_1/pt_i", "par_2", "par_2/pt_a"]


def test_identifiers_of_units_without_numbers(spark):
    lead = "In this Annex:"
    assert minted(spark, [(lead, None), ("(a) one", lead), ("tail", f"{lead}\n(a) one"), ("(b) two", None)]) == ["par_1", "par_1/pt_a", "par_1/pt_a/cont_1", "par_1/pt_b"]
    assert minted(spark, [(lead, None), (None, "")]) == ["p_0", "p_1"]  # two that would be par_1
    assert minted(spark, [("whereas (1) this", None), ("(1) that", None)], "rct_1", "recital") == ["p_0", "p_1"]
    assert minted(spark, [("1. One", None), ("loose", None)], "anx_I", "annex") == ["par_1", "p_1"]


def test_turtle(spark, tmp_path):
    (tmp_path / "v.ttl").write_text('@prefix ex: <http://x#> .\nex:A a rdfs:Class ; skos:prefLabel "Thing A"@en ; rdfs:subClassOf ex:B, ex:C .\nex:p a rdf:Property ; rdfs:label "p" .\nex:B a rdfs:Class ; rdfs:label "B" .\n')
    got = {r.subject: (r.label, r.parents) for r in files.read_terms(spark, str(tmp_path)).collect()}
    assert got == {"ex:A": ("Thing A", ["ex:B", "ex:C"]), "ex:B": ("B", [])}


def test_closure_and_roots(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "child string, parent string")
    assert {tuple(r) for r in graph.closure(edges).collect()} == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")}
    assert {tuple(r) for r in graph.roots(edges).collect()} == {("a", "b", 1), ("b", "a", 1), ("c", "c", 0)}
    n = 40  # deeper than any bound of steps, and a lattice of 2 ** 39 paths
    chain = [(f"x{i}", f"x{i + 1}") for i in range(n)]
    lattice = [(f"y{i}{s}", f"y{i + 1}{t}") for i in range(n) for s in "ab" for t in "ab"]
    edges = spark.createDataFrame(chain + lattice, "child string, parent string")
    up = graph.closure(edges)
    assert up.where("child = 'x0'").count() == n + 1 and up.where("child = 'y0a'").count() == 2 * n + 1
    got = {r.child: (r.root, r.depth) for r in graph.roots(edges).collect()}
    assert got["x0"] == (f"x{n}", n) and got["x39"] == ("x40", 1) and got["y0b"] == (f"y{n}a", n)


def test_greedy_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(g, side, p, [f"w{k}" for k in rng.integers(0, 6, rng.integers(0, 4))]) for g in range(25) for side in "lr" for p in range(int(rng.integers(0, 6)))]
    df = spark.createDataFrame(rows, "g int, side string, position long, tokens array<string>")
    got = gold.align(df.where("side = 'l'"), df.where("side = 'r'"), ["g"]).collect()
    want = set()
    for g in range(25):
        a, b = ({p: set(t) for h, s, p, t in rows if h == g and s == side} for side in "lr")
        score = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        pairs = sorted(((-score(x, y), i, j) for i, x in a.items() for j, y in b.items()))
        while pairs:
            s, i, j = pairs[0]
            want.add((g, "pair", i, j, round(-s, 6)))
            pairs = [p for p in pairs if p[1] != i and p[2] != j]
        taken = {(w[2], w[3]) for w in want if w[0] == g}
        want |= {(g, "missing", i, None, None) for i in a if i not in {t[0] for t in taken}} | {(g, "extra", None, j, None) for j in b if j not in {t[1] for t in taken}}
    assert {(r.g, r.kind, r.l, r.r, r.score) for r in got} == want


def test_slots_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(g, int(run), p, [f"w{k}" for k in rng.integers(0, 5, rng.integers(0, 4))]) for g in range(12) for run in range(3) for p in range(int(rng.integers(0, 4)))]
    got = {(r.g, r.run, r.position): r.slot for r in gold.cluster_runs(spark.createDataFrame(rows, "g int, run int, position long, tokens array<string>"), ["g"]).collect()}
    want = {}
    for g in range(12):
        slots = []
        for _, run, p, t in sorted(r for r in rows if r[0] == g):
            own = set(t)
            like = [(sum(1.0 if not own and not m else len(own & m) / len(own | m) for _, m in s) / len(s), -k) for k, s in enumerate(slots) if all(r != run for r, _ in s)]
            k = -max(like)[1] if like else len(slots)  # the best free slot takes a record, however little they share
            if k == len(slots):
                slots.append([])
            slots[k].append((run, own))
            want[g, run, p] = k
    assert got == want


def test_references_match(spark):
    cases = [(["a/b"], ["a"], True), (["a"], ["ab"], False), (["a", "a/b"], ["a/b", "a"], True), ([], [], True), (["a"], [], False), ([], ["a"], False), (["a"], ["a", "c"], False), (None, None, True)]
    df = spark.createDataFrame([(i, g, r) for i, (g, r, _) in enumerate(cases)], "i int, g array<string>, r array<string>")
    got = df.select("i", gold.references_match(F.col("g"), F.col("r")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [c[2] for c in cases]


def test_gold_against_itself(spark):
    """What is compared with itself has no differences."""
    element = "struct<value:string,method:string>"
    rows = [("a#s1", "DEONTIC", "OBLIGATION", "a", ["b", "a#s2"], [("the firm", "STATED")], [("shall pay", "STATED")], [("a fee", "CONTEXT")], ("If asked.", "STATED"), None), ("a#s2", "DEONTIC", "PERMISSION", "a", None, [("x", None)], [(None, "NONE")], None, None, True)]
    df = spark.createDataFrame(rows, f"statement_id string, statement_class string, modality string, source_article string, references array<string>, subject array<{element}>, predicate array<{element}>, object array<{element}>, condition {element}, needs_review boolean")
    pairs = df.select(F.col("statement_id").alias("gold_id"), F.col("statement_id").alias("run_id"))
    got = gold.compare(pairs, gold.canonical(df), gold.canonical(df)).collect()
    assert [(r.hard, r.soft, r.bucket) for r in got] == [([], [], "clean")] * 2


def test_upserts(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1), (2, "w", 1)], "k int, v string, seq int")
    assert {tuple(r) for r in graph.last_by_key(df, ["k"], "seq").select("k", "v").collect()} == {(1, "y"), (2, "z")}
    table = spark.createDataFrame([(1, "old", "stays"), (3, "c", "d")], "k int, v string, u string")
    new = spark.createDataFrame([(1, "new"), (4, "e"), (3, None)], "k int, v string")
    assert {tuple(r) for r in graph.upsert(table, new, ["k"]).collect()} == {(1, "new", "stays"), (3, "c", "d"), (4, "e", None)}


def test_guard(spark):
    spark.range(3).createOrReplaceTempView("guarded")
    assert sqlguard.rejected(spark, "SELECT id FROM guarded") is None
    assert "writes" in sqlguard.rejected(spark, "DROP VIEW guarded")
    assert sqlguard.rejected(spark, "SELECT nothing FROM guarded")
    out, log = sqlguard.run_generated(spark, lambda e: "SELECT id FROM guarded" if e else "SELEC")
    assert out.count() == 3 and len(log) == 2


def test_models(spark):
    rows = spark.createDataFrame([("p",), ("q",)], "prompt string")
    got = {r.prompt: (r.answer, r.error is None) for r in models.ask(rows, models.Replay({"p": "yes"}), waits=()).collect()}
    assert got == {"p": ("yes", True), "q": (None, False)}


def small_graph(spark, rows, refs=(), broader=(("x:none", "x:top"),)):
    """rows: id, modality, paragraph, conditions, subject, predicate, object."""
    s = spark.createDataFrame([(r[0], "DEONTIC", r[1], r[2], r[3], None, False) for r in rows], "id string, statement_class string, modality string, paragraph_iri string, conditions array<string>, term string, synthetic boolean")
    slots = spark.createDataFrame([(r[0], rel, iri) for r in rows for rel, iri in zip(("SUBJECT", "PREDICATE", "OBJECT"), r[4:]) if iri], "id string, rel string, iri string")
    return verify.Graph(s, slots, s.select("id", F.col("paragraph_iri").alias("provision")), spark.createDataFrame(list(refs), "id string, target string"), spark.createDataFrame(list(broader), "child string, parent string"))


def test_exception_resolves_tension(spark):
    rows = [("a", "PROHIBITION", "g:art_7/par_1", [], "s", "p", "o"), ("b", "PERMISSION", "g:art_7/par_1", ["x"], "s", "p", "o"), ("c", "OBLIGATION", "g:art_8/par_1", ["x"], "s", "q", "o/up"), ("d", "OBLIGATION", "g:art_9/par_1", [" "], "s", "q", "z"), ("e", "PROHIBITION", "g:art_6/par_1", ["x"], "s", "p", "z")]
    g = small_graph(spark, rows, [("d", "g:art_6/par_1")], [("o", "o/up")])
    got = {(r.a, r.b): (r.verdict, r.resolved) for r in verify.contradictions(verify.polar_pairs(g)).collect()}
    # d refers to e's provision, and in another article that is neither an exception nor a tension
    assert got == {("a", "b"): ("exception_structure", False), ("a", "c"): ("candidate_contradiction", True), ("d", "e"): ("none", False)}
    every = {(r.a, r.b): r.verdict for r in verify.contradictions(verify.polar_pairs(g, everything=True)).collect()}
    assert every == {("a", "b"): "exception_structure", ("a", "c"): "candidate_contradiction", ("a", "d"): "none", ("b", "e"): "none", ("c", "e"): "none", ("d", "e"): "none"}


def test_generic_concepts_are_no_evidence(spark):
    rows = [(f"n{i}", "OBLIGATION", f"g:art_{i}/par_1", ["x"], f"s{i}", "wide", f"o{i}") for i in range(9)]
    rows += [("x", "OBLIGATION", "g:art_90/par_1", ["x"], "s", "wide", "wide"), ("y", "DISPENSATION", "g:art_91/par_1", ["x"], "s", "wide", "wide"), ("z", "DISPENSATION", "g:art_92/par_1", ["x"], "s", "wide", "o")]
    g = small_graph(spark, [*rows, ("w", "OBLIGATION", "g:art_93/par_1", ["x"], "s", "wide", "o")])
    got = {(r.a, r.b): r.verdict for r in verify.contradictions(verify.polar_pairs(g)).collect()}
    assert {r.concept for r in verify.generic_concepts(g).collect()} >= {"wide"}
    assert got[("w", "z")] == ("candidate_contradiction" if "o" not in {r.concept for r in verify.generic_concepts(g, 0.1).collect()} else "none") and got[("x", "y")] == "none"


def test_conflicts_across_regulations(spark):
    rows = [("aiact:1", "OBLIGATION", "aiact:art_12/par_1", [], "p", "keep", "vair:LoggingMeasure"), ("gdpr:1", "OBLIGATION", "gdpr:art_5/par_1", [], "c", "keep", "dpv:StorageDeletion/narrow"), ("gdpr:2", "PERMISSION", "gdpr:art_5/par_2", [], "c", "keep", "dpv:StorageDeletion"), ("aiact:2", "OBLIGATION", "aiact:art_13/par_1", [], "p", "tell", "other")]
    g = small_graph(spark, rows, [("aiact:1", "x")], [("dpv:StorageDeletion/narrow", "dpv:StorageDeletion")])
    patterns = spark.createDataFrame([("logs", "aiact:", ["OBLIGATION"], ["vair:LoggingMeasure"], "gdpr:", ["OBLIGATION", "PROHIBITION"], ["dpv:StorageDeletion"])], "pattern string, a_regulation string, a_modalities array<string>, a_concepts array<string>, b_regulation string, b_modalities array<string>, b_concepts array<string>")
    pairs = verify.conflict_pairs(verify.conflict_sides(g, patterns))
    assert [tuple(r) for r in pairs.collect()] == [("logs", "aiact:1", "gdpr:1", False)]
    verdicts = pairs.select("a", "b").withColumns({"verdict": F.lit("conflict"), "resolved": F.lit(False)})
    assert {r.id: r.status for r in verify.dispositions(g.statements, verdicts).collect()} == {"aiact:1": "flagged", "gdpr:1": "flagged", "gdpr:2": "verified", "aiact:2": "verified"}
    assert {r.status for r in verify.dispositions(g.statements, verdicts, hold_out=False).collect()} == {"verified"}


def test_streamed_log(spark, tmp_path):
    from tessella.streaming import logs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"k": k, "n": n}) for k, n in [(1, 1), (1, 2), (2, 5)]))
    stream = logs.latest(logs.read_log(spark, str(tmp_path / "in"), "k int, n int"), "k", ["n"], ["n"])
    query = stream.writeStream.format("memory").queryName("latest_rows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("latest_rows").collect()} == {(1, 2), (2, 5)}


@pytest.mark.parametrize("name", ["tessella.llm", "corpus_pipeline"])
def test_library_does_not_import(name):
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[1]
    for path in root.glob("tessella/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(rf"import {name}|from {name}|from \.+llm", path.read_text()), path


def test_references():
    got = [(r[1], r[3], r[5], r[7]) for r in xref.references("Articles 15 to 18 and 20; point (a), (b) of Article 6(1); Article 5(2)(b)(iv); paragraph 2; Annex III; Article 9 of Regulation (EU) No 2016/679 and Directive 95/46/EC. Chapter II. articles 3")]
    assert ("Articles 15 to 18 and 20", "article", None, []) in got and all((f"Article {n}", "article", None, []) in got for n in (16, 17, 18, 20))
    assert ("point (a), (b) of Article 6(1)", "point", None, ["1.", "(a)"]) in got and ("point (b) of Article 6", "point", None, ["1.", "(b)"]) in got
    assert ("Article 5(2)(b)(iv)", "article", None, ["2.", "(b)", "(iv)"]) in got
    assert ("Article 9 of Regulation (EU) No 2016/679", "article", "Regulation (EU) 2016/679", []) in got
    assert sum(kind == "regulation" for _, kind, _, _ in got) == 0 and ("Directive 95/46/EC", "directive", None, []) in got and ("Chapter II", "chapter", None, []) in got
    assert ("Article 6(1)", "article", None, ["1."]) in got  # its point takes it out when both are resolved
    assert not any(raw.startswith("articles") for raw, *_ in got)
    assert xref.references(None) == []


def test_resolution(spark):
    rows = [("gdpr", "art_5", 0, "see Article 6(1), point (a) of Article 6(1) and paragraph 2", "gdpr:art_5/par_1", None), ("gdpr", "art_5", 1, "2. x", "gdpr:art_5/par_2", None), ("gdpr", "art_6", 0, "1. y:", "gdpr:art_6/par_1", None), ("gdpr", "art_6", 1, "(a) z", "gdpr:art_6/par_1/pt_a", "1. y:"), ("gdpr", "art_6", 2, "(i) deep", "gdpr:art_6/par_1/pt_a/pt_i", "1. y:\n(a) z"), ("gdpr", "art_4", 0, "(16) main", "gdpr:art_4/par_16", None), ("gdpr", "art_10", 0, "Plain", "gdpr:art_10/par_1", None), ("aiact", "art_10", 0, "Article 6 of Regulation (EU) 2016/679, Article 6(1)(a)(i) of Regulation (EU) 2016/679, Articles 99 and 10", "aiact:art_10/par_1", None), ("gdpr", "art_7", 0, "Article 4(16), Article 10(1), Article 9 of Regulation (EU) 2019/1", "gdpr:art_7/par_1", None)]
    p = spark.createDataFrame([(*r, i != 3) for i, r in enumerate(rows)], "source string, unit_id string, paragraph_index int, text string, iri string, parent_text string, screen_keep boolean")
    found = xref.resolve(xref.extract(p), p).collect()
    got = {r.raw: r.resolved_iri for r in found}
    assert got == {"point (a) of Article 6(1)": "gdpr:art_6/par_1/pt_a", "paragraph 2": "gdpr:art_5/par_2", "Article 6 of Regulation (EU) 2016/679": "gdpr:art_6/par_1", "Article 6(1)(a)(i) of Regulation (EU) 2016/679": "gdpr:art_6/par_1/pt_a/pt_i", "Articles 99 and 10": None, "Article 4(16)": "gdpr:art_4/par_16", "Article 10(1)": "gdpr:art_10/par_1", "Article 9 of Regulation (EU) 2019/1": None}
    assert {r.raw for r in found if r.text is not None} == {"paragraph 2", "Article 4(16)", "Article 10(1)"}  # the point's text was not kept


def test_roles(spark):
    df = spark.createDataFrame([("a member", "A member shall be dismissed by the board."), ("the provider", "The provider shall test."), ("an enterprise of some size", "This shall not apply to an enterprise of any size.")], "s string, t string")
    got = df.select(roles.is_patient(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, True]  # the last by its first three words
    one = spark.range(1).select(roles.is_actor(F.lit("Data Controller")), roles.snapped_role(F.lit("AI providers")), roles.inferred_bearer(F.array(F.lit("none"), F.lit("the notified body of a provider")), F.lit("the controller")), roles.names_actor(F.lit("Supervisory Authorities"))).first()
    assert tuple(one) == (True, "the provider", "the notified body", True)


def test_extraction_by_replay(spark):
    class Rules:
        def __call__(self, prompt):
            if "broken" in prompt:
                raise ValueError("no")
            if prompt.startswith("classify"):
                return json.dumps({"candidates": [{"statement_class": "DEONTIC", "anchor": "shall pay", "rationale": "r"}, {"statement_class": "NOT_APPLICABLE", "anchor": "-", "rationale": "n"}, {"statement_class": "NOT_APPLICABLE", "anchor": "-", "rationale": "n"}]})
            return json.dumps({"modality": "OBLIGATION", "subject": [{"value": "the controller", "method": "STATED"}], "predicate": [{"value": "shall pay", "method": "STATED"}], "object": [{"value": "a fee", "method": "STATED"}], "confidence": 0.6})

    p = spark.createDataFrame([("gdpr:art_1/par_1", "gdpr", "article", "The controller shall pay a fee.", None), ("gdpr:art_2/par_1", "gdpr", "article", "broken", None), ("gdpr:rct_1/p_0", "gdpr", "recital", "whereas", None)], "paragraph_iri string, source string, unit_type string, text string, heading string")
    none = {"parents": "array<struct<iri:string,text:string>>", "cross_references": "array<struct<raw:string,resolved_iri:string,citation_surface:string,text:string>>", "previous": "struct<text:string>", "next": "struct<text:string>"}
    p = p.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    got = {(r.statement_id, r.statement_class, r.needs_review): (r.classification_rationale, r.extractor_error, r.predicate) for r in extract.extract_statements(p, Rules()).collect()}
    assert set(got) == {("gdpr:art_1/par_1#s1", "DEONTIC", True), ("gdpr:art_1/par_1#na", "NOT_APPLICABLE", False), ("gdpr:art_2/par_1#na", "NOT_APPLICABLE", True), ("gdpr:rct_1/p_0#na", "NOT_APPLICABLE", False)}
    assert got["gdpr:art_1/par_1#s1", "DEONTIC", True][2][0].value == "pay" and got["gdpr:art_1/par_1#na", "NOT_APPLICABLE", False][0] == "n"
    assert got["gdpr:art_2/par_1#na", "NOT_APPLICABLE", True][1] == "ValueError: no" and got["gdpr:rct_1/p_0#na", "NOT_APPLICABLE", False][0] == "DEONTIC suppressed on recital — r | n"
    back = extract.reread(spark.createDataFrame([(1, "S shall pay.")], "id int, sentence string"), Rules()).first()
    assert back.modality == "OBLIGATION" and back.extractor_error is None


def test_exception_splits(spark):
    e = lambda v: [(v, "STATED")]
    rows = [  # a dispensation that repeats its obligation's own condition goes; one with scope of its own stays; a cue alone is to be reviewed
        ("p1", 0, "OBLIGATION", e("notify"), e("the breach to the authority"), ("unless unlikely to result in a risk", "STATED"), ["g:art_3"]),
        ("p1", 1, "DISPENSATION", e("notify"), e("the breach to the authority"), ("unlikely to result in a risk", "STATED"), None),
        ("p2", 0, "PERMISSION", e("process"), e("special data"), ("where consent is given", "STATED"), None),
        ("p2", 1, "PROHIBITION", e("process"), e("special data"), ("except where a law forbids", "STATED"), None),
        ("p2", 2, "PROHIBITION", e("sell"), e("special data"), ("where consent is given", "STATED"), None),
    ]
    el = "array<struct<value:string,method:string>>"
    df = spark.createDataFrame([(r[0], r[1], "DEONTIC", *r[2:], False) for r in rows], f"paragraph_iri string, emission int, statement_class string, modality string, predicate {el}, object {el}, condition struct<value:string,method:string>, references array<string>, needs_review boolean")
    got = {(r.paragraph_iri, r.emission): (r.merged_exception_split, r.exception_split_ambiguous) for r in passes.merge_exception_splits(df).collect()}
    assert set(got) == {("p1", 0), ("p2", 0), ("p2", 1), ("p2", 2)}
    assert got["p1", 0][0].dropped_modality == "DISPENSATION" and got["p2", 0] == (None, True) and got["p2", 1] == (None, True) and got["p2", 2] == (None, False)


def test_files(spark, tmp_path):
    for run, n in ((1, 2), (2, 3)):
        (tmp_path / f"run{run}.extracted.jsonl").write_text("\n".join(json.dumps({"k": k}) for k in range(n)))
    (tmp_path / "other.jsonl").write_text(json.dumps({"k": 9}))
    assert sorted((r.run_id, r.k) for r in files.read_runs(spark, str(tmp_path)).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert [r.k for r in files.read_jsonl(spark, str(tmp_path / "run2.extracted.jsonl"), limit=2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        files.read_mapped(spark, str(tmp_path / "other.jsonl"), ".content_mapped.jsonl")
    assert files.read_mapped(spark, str(tmp_path), ".extracted.jsonl").count() == 5
    (tmp_path / "map.json").write_text(json.dumps({"a": "x", "b": "y"}))
    assert {tuple(r) for r in files.read_map(spark, str(tmp_path / "map.json")).collect()} == {("a", "x"), ("b", "y")}
    (tmp_path / "routing.json").write_text(json.dumps({"_doc": "x", "object": {"gdpr": [{"vocab": "v", "by": "scheme", "values": ["s", "t"]}]}, "predicate": {"gdpr": [{"vocab": "w", "by": "all"}]}}))
    assert {tuple(r) for r in files.read_routing(spark, str(tmp_path / "routing.json")).collect()} == {("object", "gdpr", "v", "scheme", "s", 0), ("object", "gdpr", "v", "scheme", "t", 0), ("predicate", "gdpr", "w", "all", None, 0)}
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_jsonl(df, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() == 2
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("ts is not null").count() == 4
    files.write_document(df.orderBy("k"), str(tmp_path / "doc"))
    assert json.loads(spark.read.text(str(tmp_path / "doc")).first()[0]) == [{"k": 1, "v": "a"}, {"k": 2, "v": None}]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "gdpr_en.html").write_text("<p>x</p>")
    assert [tuple(r) for r in files.read_pages(spark, str(tmp_path / "pages"), ["aiact", "gdpr"]).collect()] == [("gdpr", "<p>x</p>")]
    version = answer.index_version(F.lit("m"), df.select(F.col("k").cast("string").alias("provision"), F.col("v").alias("text"))).first()[0]
    assert files.read_index(spark, version, str(tmp_path / "index")) is None
    files.write_index(df, version, str(tmp_path / "index"))
    assert files.read_index(spark, version, str(tmp_path / "index")).count() == 2
    assert version != answer.index_version(F.lit("m"), df.limit(1).select(F.col("k").cast("string").alias("provision"), F.col("v").alias("text"))).first()[0]
    verdict = spark.createDataFrame([(1, ("INSUFFICIENT",)), (2, ("COMPLIANT",))], "query_id int, verdict struct<verdict:string>")
    files.append_review(verdict, str(tmp_path / "queue"))
    assert [r.query_id for r in spark.read.json(str(tmp_path / "queue")).collect()] == [1]


def test_similar_sets_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [sorted({f"w{k}" for k in rng.integers(0, 60, rng.integers(1, 40))}) for _ in range(60)]
    sets += [sorted({*s, "extra"} - {s[0]}) for s in sets[:20]] + sets[:5] + [[]]
    df = spark.createDataFrame([(i, "x", s) for i, s in enumerate(sets)], "id long, lang string, tokens array<string>")
    for least in (0.5, 0.8):
        got = {(r.a, r.b): (r.a_copies, r.b_copies, r.jaccard) for r in matching.similar_pairs(df, ["lang"], "id", least).collect()}
        first = {tuple(s): i for i, s in reversed(list(enumerate(sets))) if s}
        copies = {i: sum(tuple(x) == s for x in map(tuple, sets)) for s, i in first.items()}
        want = {}
        for s, i in first.items():
            for t, j in first.items():
                score = len(set(s) & set(t)) / len(set(s) | set(t))
                if i < j and score >= least:
                    want[i, j] = (copies[i], copies[j], round(score, 6))
        assert got == want


def test_more_queries_than_a_slice(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    whole, sliced = (sorted(map(tuple, retrieve.top_k(q, v, 3, at_once=n).collect())) for n in (1000, 7))
    assert whole == sliced and len(whole) == 180


def test_labels_count_for_their_check_alone(spark):
    verdicts = spark.createDataFrame([("contradiction", "x", "y", "candidate_contradiction", False), ("cross_regulation", "x", "y", "conflict", False)], "check string, a string, b string, verdict string, resolved boolean")
    s = spark.createDataFrame([("x",), ("y",)], "id string")
    label = lambda *rows: spark.createDataFrame(list(rows), "check string, a string, b string, label string")
    one = label(("cross_regulation", "y", "x", "none"))
    assert {r.status for r in verify.dispositions(s, verdicts, one).collect()} == {"flagged"}
    assert [r.rel for r in verify.verification_edges(verdicts, one).collect()] == ["CANDIDATE_CONTRADICTION"]
    both = label(("cross_regulation", "y", "x", "none"), ("cross_regulation", "x", "y", "conflict"), ("contradiction", "y", "x", "none"))
    assert {r.status for r in verify.dispositions(s, verdicts, both).collect()} == {"verified_after_review"}
    assert [r.rel for r in verify.verification_edges(verdicts, both).collect()] == ["CONFLICTS_WITH"]
    # a pair's own row goes before that of the pair turned round, even where it is empty
    own = label(("cross_regulation", "y", "x", "none"), ("cross_regulation", "x", "y", ""), ("contradiction", "y", "x", "none"))
    assert {r.status for r in verify.dispositions(s, verdicts, own).collect()} == {"flagged"}
    last = spark.createDataFrame([("contradiction", "x", "y", "zz", 1), ("contradiction", "x", "y", "none", 2)], "check string, a string, b string, label string, position int")
    assert {r.label for r in verify.oriented_labels(last).collect()} == {"none"}


def test_flags_of_sides_and_classes_are_those_of_their_pairs(spark):
    sides = [("p", "a", "s0"), ("p", "a", "s1"), ("p", "b", "s2"), ("p", "b", "s3"), ("q", "a", "s2"), ("q", "b", "s4")]
    others = {(p, e): sum(1 for q, f, _ in sides if q == p and f != e) for p, e, _ in sides}
    classes = [("s4", "s4", 3), ("s5", "s4", 3), ("s6", "s4", 3)]
    labels = [("cross_regulation", "s0", "s2", "conflict"), ("cross_regulation", "s3", "s0", "none"), ("cross_regulation", "s2", "s1", ""), ("cross_regulation", "s4", "s2", "none"), ("redundancy", "s5", "s4", "none"), ("redundancy", "s4", "s6", "x"), ("redundancy", "s0", "s2", "none"), ("cross_regulation", "s0", "s1", "none")]
    reviewed = spark.createDataFrame(labels, "check string, a string, b string, label string")
    pairs = [("cross_regulation", x, y, "conflict", False) for p, e, x in sides for q, f, y in sides if p == q and (e, f) == ("a", "b")]
    pairs += [("redundancy", x, y, "duplicate_definition", False) for x, _, _ in classes for y, _, _ in classes if x < y]
    schema = "check string, a string, b string, verdict string, resolved boolean"
    expanded, none = spark.createDataFrame(pairs, schema), spark.createDataFrame([], schema)
    groups = {"sides": spark.createDataFrame([(*r, others[r[:2]]) for r in sides], "pattern string, side string, id string, others long"), "classes": spark.createDataFrame(classes, "id string, class_id string, copies long")}
    s = spark.createDataFrame([(f"s{k}",) for k in range(8)], "id string")
    for given in (reviewed, None):
        assert sorted(map(tuple, verify.flag_counts(none, given, **groups).collect())) == sorted(map(tuple, verify.flag_counts(expanded, given).collect()))
        assert sorted(map(tuple, verify.dispositions(s, none, given, **groups).collect())) == sorted(map(tuple, verify.dispositions(s, expanded, given).collect()))
    assert {r.id: r.status for r in verify.dispositions(s, none, reviewed, **groups).collect()} == {"s0": "verified_after_review", "s1": "flagged", "s2": "flagged", "s3": "flagged", "s4": "verified_after_review", "s5": "flagged", "s6": "flagged", "s7": "verified"}


def test_near_misses(spark):
    rows = [("a", "OBLIGATION", "g:art_1/par_1", [], "s", "p", "o1"), ("b", "PROHIBITION", "g:art_2/par_1", ["x"], "s", "p/up", "o2"), ("c", "OBLIGATION", "g:art_1/par_2", ["y"], "s", "p", "o3"), ("d", "OBLIGATION", "g:art_1/par_3", [], "s", "q", "o4"), ("e", "PERMISSION", "g:art_3/par_1", [], "t", "p", "o1")]
    g = small_graph(spark, rows, [("a", "x")], [("p", "p/up")])
    same = verify.redundancies(g).withColumn("check", F.lit("redundancy"))
    assert {(r.a, r.b): (r.verdict, r.pred_equal, r.obj_equal) for r in same.collect()} == {("a", "c"): ("none", True, False), ("a", "d"): ("none", False, False), ("c", "d"): ("none", False, False)}
    every = verify.contradictions(verify.polar_pairs(g, everything=True)).withColumn("check", F.lit("contradiction"))
    shown = verify.worksheet(every.unionByName(same, allowMissingColumns=True)).collect()
    assert [(r.check, r.a, r.b) for r in shown] == [("contradiction", "a", "b"), ("contradiction", "b", "c"), ("redundancy", "a", "c")]
    sides = verify.predicate_sides(g).collect()
    met = {tuple(sorted((x.id, y.id))) for x in sides for y in sides if (x.subject, x.concept) == (y.subject, y.concept) and x.named != y.named and {x.modality, y.modality} in [set(p) for p in verify.POLAR]}
    assert met == {("a", "b"), ("b", "c")}
    assert {(r.id, r.concept, r.named): r.others for r in sides} == {("a", "p/up", False): 1, ("c", "p/up", False): 1, ("b", "p/up", True): 2}


def test_equal_records_are_matched_without_their_square(spark):
    n = 5000
    left = spark.range(n).select(F.lit(None).cast("int").alias("g"), F.col("id").alias("position"), F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    right = spark.range(n + 10).select(F.lit(None).cast("int").alias("g"), F.col("id").alias("position"), F.when(F.col("id") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).when(F.col("id") % 4 == 1, F.array(F.lit("a"))).otherwise(F.lit(None)).alias("tokens"))
    key = lambda df: df.fillna(0, ["g"])
    got = {r.l: (r.r, r.score) for r in gold.matches(key(left), key(right), ["g"]).collect()}
    half, quarter = n // 2 + 5, (n + 10) // 4 + 1
    assert len(got) == n and all(got[k] == (2 * k, 1.0) for k in range(half))
    assert all(got[half + k] == (4 * k + 1, 0.5) for k in range(quarter - 1))
    assert {s for _, s in got.values()} == {1.0, 0.5, 0.0}


def test_prefixes_are_joined_at_their_lengths(spark):
    items = spark.createDataFrame([("gdpr:art_5",), ("gdpr:art_50/par_1",), ("gdpr:art_5/par_1",), ("aiact:art_5",), (None,), ("",), ("gdpr:art_5",)], "p string")
    prefixes = spark.createDataFrame([("gdpr:art_5",), ("gdpr:",), ("",), (None,), ("gdpr:art_5/par_1/pt_a",), ("gdpr:art_5",)], "prefix string")
    got = sorted(map(tuple, graph.under_prefixes(items, "p", prefixes).select("p", "prefix").collect()))
    assert got == sorted((p, x) for p in ("gdpr:art_5", "gdpr:art_50/par_1", "gdpr:art_5/par_1", "aiact:art_5", "") for x in ("gdpr:art_5", "gdpr:", "") if p.startswith(x))
    assert {r.p for r in graph.under_prefixes(items, "p", prefixes, bounded=True).where("prefix = 'gdpr:art_5'").collect()} == {"gdpr:art_5", "gdpr:art_5/par_1"}


def test_rerank_asks_for_the_first_alone(spark):
    ranked = spark.createDataFrame([(1, v, v + 1, float(s)) for v, s in enumerate([1, 5, 5, 2, 9])], "query_id int, vec_id int, rank int, second double")
    got = retrieve.rerank(ranked, F.col("second"), 2, first=4).orderBy("rank").collect()
    assert [(r.vec_id, r.rank, r.first_rank, r.score) for r in got] == [(1, 1, 2, 5.0), (2, 2, 3, 5.0)]
