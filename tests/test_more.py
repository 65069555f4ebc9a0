"""Operators that no query calls, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tessella import __main__ as cli
from tessella.operators import answer, candidates, changes, evaluate, extract, gold, lemmas, models, structure, verify, worksheets
from tessella.sources import files, html
from tessella.streaming import logs

SF = "/root/testdata/sf0.001"


def test_covered_provisions(spark):
    statements = spark.createDataFrame([("a", True, "DEONTIC"), ("b", False, "DEONTIC"), ("c", True, "DEFINITIONAL")], "id string, verified boolean, statement_class string")
    sources = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p1"), ("c", "p3")], "id string, provision string")
    provisions = spark.createDataFrame([("p1", "one"), ("p2", "two")], "provision string, text string")
    assert {tuple(r) for r in answer.covered(statements, sources, provisions).collect()} == {("p1", "one"), ("p3", None)}
    assert [r.id for r in answer.verified(statements, statement_class="DEONTIC").collect()] == ["a"]


def test_bounded_prefixes(spark):
    statements = spark.createDataFrame([(x, True) for x in "abc"], "id string, verified boolean")
    sources = spark.createDataFrame([("a", "gdpr:art_5"), ("b", "gdpr:art_50/par_1"), ("c", "gdpr:art_5/par_1")], "id string, provision string")
    prefixes = spark.createDataFrame([(1, "gdpr:art_5"), (2, "gdpr")], "query_id int, prefix string")
    raw = {(r.query_id, r.id) for r in answer.seeds_below(statements, sources, prefixes).collect()}
    assert raw == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c")}
    assert {(r.query_id, r.id) for r in answer.seeds_below(statements, sources, prefixes, bounded=True).collect()} == {(1, "a"), (1, "c")}
    assert answer.seeds_below(statements, sources, prefixes, most=2).count() == 4


def test_models_answer_questions(spark):
    class Rules:
        def __call__(self, prompt):
            if "broken" in prompt:
                raise ValueError("no")
            return json.dumps({"mode": "ask", "target_provisions": ["p1"] if "- p1" in prompt else [], "scenario_facts": [], "rationale": "r", "verdict": "COMPLIANT", "explanation": "e", "cited": []})

    questions = spark.createDataFrame([(1, "what?"), (2, "broken")], "query_id int, question string")
    shown = spark.createDataFrame([(1, "p2"), (1, "p1")], "query_id int, provision string")
    got = {r.query_id: (r.intent, r.intent_error) for r in answer.classify(questions, shown, Rules()).collect()}
    assert got[1][0].target_provisions == ["p1"] and got[2] == (None, "ValueError: no")
    alone = {r.query_id: (r.verdict.verdict if r.verdict else None, r.seed_path) for r in answer.model_only(questions, Rules()).collect()}
    assert alone == {1: ("COMPLIANT", "llm_only"), 2: (None, "llm_only")}


def test_dense_choice(spark):
    vectors = spark.createDataFrame([(f"gdpr:{'rct' if i % 2 else 'art'}_{i}", [1.0 - i / 10, i / 10]) for i in range(10)], "provision string, embedding array<double>")
    questions = spark.createDataFrame([("1", [1.0, 0.0])], "query_id string, q array<double>")
    statements = vectors.select(F.col("provision").alias("id"), F.lit(True).alias("verified"))
    sources = vectors.select(F.col("provision").alias("id"), "provision")
    got = answer.choose_seeds(questions, statements, sources, questions, vectors, dense=True).collect()
    assert {r.seed_path for r in got} == {"dense_retrieval"} and sorted(r.id for r in got) == [f"gdpr:art_{i}" for i in range(0, 10, 2)]
    assert sorted(r.provision for r in answer.dense_provisions(questions, vectors, 2, 2).collect()) == ["gdpr:art_0", "gdpr:art_2"]  # the first four hold two recitals


def test_rows_to_adjudicate(spark):
    rows = spark.createDataFrame([("object", "gdpr", "v", "a", 2, "review"), ("object", "gdpr", "w", "a", 5, "review"), ("object", "gdpr", "x", "a", 9, "mapped")], "slot string, regulation string, value string, article string, n long, status string")
    assert [r.value for r in candidates.to_adjudicate(rows).collect()] == ["w", "v"] and [r.value for r in candidates.to_adjudicate(rows, 1).collect()] == ["w"]


def test_tags_without_an_equal_label(spark):
    values = spark.createDataFrame([("object", "g", "v", "a", 1, ["p"])], "slot string, regulation string, value string, article string, n long, paragraphs array<string>")
    labels = spark.createDataFrame([("object", "g", "x:1", "Storage Limitation Principle"), ("object", "g", "x:2", "storage limitation of the whole principle set"), ("object", "g", "x:3", "storage")], "slot string, regulation string, iri string, label string")
    tags = spark.createDataFrame([("p", "storage limitation")], "paragraph string, tag string")
    assert [r.iri for r in candidates.tag_matches(values, labels, tags).collect()] == ["x:1"]


def test_inputs_and_parents(spark):
    statements = spark.createDataFrame([("s1", "p1"), ("s2", "p9")], "statement_id string, paragraph_iri string")
    paragraphs = spark.createDataFrame([("p1", "text", "gdpr")], "iri string, text string, source string")
    assert {(r.statement_id, r.text) for r in extract.with_inputs(statements, paragraphs).collect()} == {("s1", "text"), ("s2", None)}
    rows = spark.createDataFrame([(1, "lead", "x")], "k int, parent_text string, y string")
    parents = spark.createDataFrame([(1, [("p", "lead")])], "k int, parents array<struct<iri:string,text:string>>")
    out = extract.rename_parents(rows, parents, ["k"])
    assert out.columns == ["k", "parents", "y"] and out.first().parents[0].iri == "p"


def test_discriminators(spark):
    rows = [("DEFINITIONAL", "The Term", None, None, None), ("APPLICABILITY", None, "MATERIAL", "INCLUDES", None), ("DEONTIC", None, None, None, "OBLIGATION"), ("NOT_APPLICABLE", None, None, None, None)]
    df = spark.createDataFrame(rows, "statement_class string, term string, scope_type string, polarity string, modality string")
    assert [r[0] for r in df.select(gold.discriminator(df)).collect()] == ["DEF|term", "APP|MATERIAL|INCLUDES", "DEO|OBLIGATION", "NA"]


def test_audit_and_empty_answers(spark):
    resolved = spark.createDataFrame([("s", "g", "mapped"), ("s", "g", "mapped"), ("t", "g", "unmapped")], "surface string, regulation string, status string")
    assert {tuple(r) for r in worksheets.audit(resolved).collect()} == {("s", "g", "mapped", 2), ("t", "g", "unmapped", 1)}
    expected, found = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1, "a"), (2, " "), (4, "b")], "id int, answer string")
    assert {tuple(r) for r in evaluate.completeness(expected, found).collect()} == {(3, "missing"), (4, "extra"), (2, "empty")}


def test_identifiers_that_clash(spark):
    rows = [("x", "art_1", "article", i, t, None) for i, t in enumerate(["1. a", "1. b", "tail"])]
    df = spark.createDataFrame(rows, "source string, unit_id string, unit_type string, paragraph_index int, text string, parent_text string")
    assert sorted(r.iri for r in structure.mint_identifiers(df).collect()) == ["x:art_1/p_0", "x:art_1/p_1", "x:art_1/p_2"]


def test_timed_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"k": k}))
    seen = []
    stream = logs.read_log(spark, str(tmp_path / "in"), "k int", per_batch=1)
    query = logs.in_batches(stream, lambda rows, n: seen.append((n, rows.count())), str(tmp_path / "at"), 0)
    query.processAllAvailable()
    query.stop()
    assert seen == [(0, 1), (1, 1), (2, 1)]


def test_known_conflicts(spark):
    none = spark.createDataFrame([], "id string, statement_class string, modality string, paragraph_iri string, conditions array<string>, term string, synthetic boolean")
    empty = verify.Graph(none, spark.createDataFrame([], "id string, rel string, iri string"), spark.createDataFrame([], "id string, provision string"), spark.createDataFrame([], "id string, target string"), spark.createDataFrame([], "child string, parent string"))
    g = verify.inject(verify.inject(empty, verify.synthetic_pair(spark)), verify.synthetic_pair(spark))
    assert g.statements.count() == 2 and g.slots.count() == 5
    got = verify.conflict_pairs(verify.conflict_sides(g, verify.patterns(spark))).collect()
    assert [tuple(r) for r in got] == [("logging_vs_storage_limitation", "syn:aiact:art_12/par_1#s1", "syn:gdpr:art_5/par_1/pt_e#s1", True)]
    assert verify.without_synthetic(g).slots.count() == 0


def test_models_with_a_deadline(spark):
    def slow(prompt):
        import time

        if prompt == "slow":
            time.sleep(20)
        return prompt.upper()

    rows = spark.createDataFrame([("a",), ("slow",), ("b",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.answer, r.error) for r in models.ask(rows, slow, waits=(), at_once=3, deadline=2.0).collect()}
    assert got["a"] == ("A", None) and got["b"] == ("B", None) and got["slow"][0] is None and "TimeoutError" in got["slow"][1]


def test_command_line(spark, tmp_path, capsys):
    cli.main(["list"])
    assert "contradiction_pairs" in capsys.readouterr().out.split()
    s = spark.createDataFrame([("a", "DEONTIC", "PROHIBITION", "g:art_1/par_1", [], None, False), ("b", "DEONTIC", "PERMISSION", "g:art_1/par_1", [], None, False), ("syn:c", "DEONTIC", "PERMISSION", "g:art_1/par_1", [], None, True)], "id string, statement_class string, modality string, paragraph_iri string, conditions array<string>, term string, synthetic boolean")
    tables = {"statements": s, "slots": s.select("id", F.lit("SUBJECT").alias("rel"), F.lit("x").alias("iri")), "sources": s.select("id", F.col("paragraph_iri").alias("provision")), "refs": s.where("false").select("id", F.col("id").alias("target")), "broader": s.where("false").select(F.col("id").alias("child"), F.col("id").alias("parent"))}
    assert tuple(tables) == verify.Graph._fields
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/graph/{name}")
    cli.check(spark, f"{tmp_path}/graph", f"{tmp_path}/out", synthetic=False)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/edges").collect()] == [("EXCEPTION_OF", "b", "a", False)]
    assert {r.status for r in spark.read.parquet(f"{tmp_path}/out/dispositions").collect()} == {"verified"}
    cli.selftest(spark, SF)


def test_whole_units(spark):
    page = (
        "<div id='cpt_IV.sct_2'><div class='x eli-subdivision' id='art_5'><p class='oj-ti-art'>Article 5</p><p class='oj-normal'>1.  One:</p><p class='oj-normal'>(1)</p>"
        "<div class='oj-enumeration-spacing'><p>spaced</p></div><div class='eli-title'><p class='oj-normal'>titled</p></div>"
        "<table><tr><td><p class='oj-normal'>(a)</p></td><td><p class='oj-normal'>deep</p></td></tr></table></div></div>"
        "<div class='eli-container' id='anx_I'><p class='oj-normal'>left out</p></div><div class='eli-subdivision' id='anx_L'><p class='oj-normal'>left out</p></div>"
        "<div class='eli-subdivision' id='rct_1'><p>no text</p></div><div class='eli-subdivision' id='anx_3'><p class='oj-ti-chp'>Title</p><p class='oj-normal'>three</p></div>"
    )
    pages = spark.createDataFrame([("a", page, 1), ("b", None, 2), ("c", "", 3), ("a", "<div class='eli-subdivision' id='fnp_1'><p class='oj-normal'>end</p></div>", 4)], "key string, page string, text int")
    got = sorted((tuple(r) for r in html.units(pages, "key", "page").collect()), key=lambda r: r[1])
    assert got == [
        ("a", "anx_3", "annex", "3", None, None, "Title", "three", ["three"]),
        ("a", "art_5", "article", "5", "IV", "2", "Article 5", "1. One:\n\ntitled\n\n(a)\n\ndeep", ["1. One:", "titled", "(a)", "deep"]),
        ("a", "fnp_1", "final_provision", "1", None, None, None, "end", ["end"]),
    ]
    assert html.units(pages.limit(0), "key", "page").collect() == []


#: Forms of legal English with their base, verb before noun.
FORMS = """ensures ensure|ensured ensure|ensuring ensure|processes process|processed process|processing process|carries carry|carried carry|carrying carry|applies apply|applied apply|applying apply
provides provide|provided provide|providing provide|provisions provision|authorities authority|bodies body|notified notify|notifies notify|notifying notify|controllers controller|processors processor
planned plan|planning plan|referred refer|referring refer|committed commit|permitting permit|submitted submit|transferred transfer|controlled control|taken take|took take|given give|laid lay|drawn draw
measures measure|statuses status|analyses analysis|criteria criterion|indices index|appendices appendix|lives life|women woman|taxes tax|boxes box|branches branch|dishes dish|losses loss|businesses business
assessed assess|assesses assess|assessing assess|issued issue|issues issue|used use|using use|makes make|making make|kept keep|held hold|monitors monitor|monitored monitor|monitoring monitor
risks risk|rights right|systems system|data data|basis basis|access access|persons person|freedoms freedom|safeguards safeguard|obligations obligation|interests interest|purposes purpose|categories category
limited limit|limiting limit|restricted restrict|erased erase|erasing erase|rectified rectify|withdrawn withdraw|informed inform|informing inform|communicated communicate|communicating communicate
demonstrates demonstrate|demonstrated demonstrate|verified verify|verifying verify|designated designate|designating designate|established establish|establishes establish|establishing establish
complies comply|complied comply|complying comply|deployed deploy|deployers deployer|placing place|placed place|marketed market|parties party|copies copy|copied copy|children children|gdpr gdpr|2016 2016"""


def test_lemmas_are_in_the_lexicon(spark):
    forms = [x.split() for x in FORMS.replace("\n", "|").split("|")]
    bases = sorted({b for _, b in forms if b != "children"})
    lexicon = spark.createDataFrame([(b, 1) for b in bases], "word string, n long")
    words = spark.createDataFrame([(w, 7) for w, _ in forms] + [(None, 0), ("", 0), ("zzzs", 1)], "word string, lemma int")
    got = {r.word: r.lemma for r in lemmas.lemma_table(words, lexicon).collect()}
    assert got == {w: b for w, b in forms} | {"": "", "zzzs": "zzzs"}
    assert lemmas.lemma_table(words, lexicon.limit(0)).where("word = 'ensures'").first().lemma == "ensures"


def test_lexicon_decides_between_bases(spark):
    words = spark.createDataFrame([("rated",), ("news",)], "word string")
    lexicon = lambda *rows: spark.createDataFrame(rows, "word string, n long, pos string")
    lemma = lambda lex: {r.word: r.lemma for r in lemmas.lemma_table(words, lex).collect()}
    assert lemma(lexicon(("rate", 5, "v"), ("rat", 3, None), ("new", 9, "a")))  == {"rated": "rate", "news": "news"}
    assert lemma(lexicon(("rate", 5, "v"), ("rat", 30, None), ("new", 9, None))) == {"rated": "rat", "news": "new"}
    assert lemma(lexicon(("rate", 5, "v"), ("rat", 30, "n"), ("rat", 5, "n"))) == {"rated": "rate", "news": "news"}


def test_ungrounded_words(spark):
    values = spark.createDataFrame([(1, "object", "the Provisions ensured by bodies, provisions", "x"), (1, "object", None, "x"), (2, "object", "data", "x"), (None, "object", "the data", "x"), (1, "object", "", "x"), (2, "object", "data", "y")], "id int, field string, value string, text string")
    sources = spark.createDataFrame([(1, "A provision ensures it"), (1, None), (3, "data")], "id int, text string")
    lexicon = spark.createDataFrame([(w, 1) for w in "provision ensure body".split()], "word string, n long")
    got = sorted((str(r.id), str(r.value), r.text, tuple(r.missing)) for r in lemmas.ungrounded(values, sources, lexicon, candidates.STOP).collect())
    assert got == [("1", "", "x", ()), ("1", "None", "x", ()), ("1", "the Provisions ensured by bodies, provisions", "x", ("bodies",)), ("2", "data", "x", ("data",)), ("2", "data", "y", ("data",)), ("None", "the data", "x", ("data",))]
    assert lemmas.ungrounded(values.limit(0), sources, lexicon, candidates.STOP).count() == 0


def test_batches_of_changes(spark, tmp_path):
    import os

    path, keys = f"file://{tmp_path}/edges", ["src", "rel"]
    frame = lambda *rows: spark.createDataFrame(rows, "src string, rel string, status string, run int, op string")
    rows = lambda: sorted((tuple(r) for r in changes.current(spark, path).select("src", "rel", "status", "run").collect()), key=str)
    stamp = lambda: {f: os.stat(f).st_mtime_ns for f in map(str, tmp_path.glob("edges/**/*.parquet"))}
    put = [(f"s{i}", "to", "new", i % 2, "put") for i in range(40)]
    changes.apply(path, frame(*put, (None, "to", "x", 1, "put"), ("s1", "to", "new", 1, "put"), ("s0", "to", "a", 0, None), ("s0", "to", None, 0, "delete")), keys, 1, 8)
    first = rows()
    assert len(first) == 40 and first[0] == ("s0", "to", "new", 0)
    changes.apply(path, frame(("s3", "to", None, 9, "put"), ("s99", "to", "late", 1, "put")), keys, 2, 8)
    second = rows()
    assert ("s3", "to", "new", 9) in second and len(second) == 41
    before = stamp()
    changes.apply(path, frame(("s3", "to", None, None, "delete")), keys, 3, 8)
    assert len(rows()) == 40 and sum(before.get(f) != t for f, t in stamp().items()) == 1  # one bucket of eight
    third = rows()
    for batch in (1, 2, 3):
        changes.replay(spark, path, batch, keys, 8)
        assert rows() == third  # neither the deleted row nor old values come back
    changes.apply(path, frame(("s3", "to", "back", None, "put")), keys, 4, 8)
    assert ("s3", "to", "back", None) in rows()
    changes.delete_where(spark, path, "run = 1", keys, 5, 8)
    assert all(r[3] != 1 for r in rows()) and len(rows()) == 21 and changes.stored(spark, path).count() == 41
    changes.apply(path, frame(("s0", "to", "x", 0, "put")).limit(0), keys, 6, 8)
    with pytest.raises(ValueError):
        changes.apply(path, frame(("s0", "to", "x", 0, "put")), keys, 7, 4)


def test_stream_state_restarts_and_expires(spark, tmp_path):
    schema = "user string, ts timestamp, n int, ts2 string"
    path, at, source = f"file://{tmp_path}/table", f"file://{tmp_path}/at", tmp_path / "in"
    source.mkdir()

    def feed(name, *rows):
        (source / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("user", "ts", "n"), r))) for r in rows))
        stream = logs.first_and_latest(logs.read_log(spark, str(source), schema, 1), "user", "ts", ["n", "ts2"], "1 hour", "2 days")
        logs.into_table(stream, path, ["user"], at, 4).awaitTermination()
        return {r.user: (str(r.first_seen), str(r.last_seen), r.n) for r in changes.current(spark, path).collect()}

    got = feed("a", ("u", "2024-01-01 10:00:00", 1), ("u", "2024-01-01 10:00:00", 2), ("v", "2024-01-01 11:00:00", 3), (None, "2024-01-01 10:00:00", 4), ("w", None, 5))
    assert got == {"u": ("2024-01-01 10:00:00", "2024-01-01 10:00:00", 2), "v": ("2024-01-01 11:00:00", "2024-01-01 11:00:00", 3)}
    # a new run from the checkpoint: earlier state goes on, an earlier row moves first_seen alone, and one beyond the watermark is left out
    got = feed("b", ("u", "2024-01-01 12:00:00", None), ("v", "2024-01-01 10:30:00", 9), ("u", "2024-01-01 01:00:00", 7))
    assert got == {"u": ("2024-01-01 10:00:00", "2024-01-01 12:00:00", None), "v": ("2024-01-01 10:30:00", "2024-01-01 11:00:00", 3)}
    feed("c", ("x", "2024-01-09 00:00:00", 1))
    got = feed("d", ("u", "2024-01-09 01:00:00", 8))
    assert got["u"] == ("2024-01-09 01:00:00", "2024-01-09 01:00:00", 8) and got["v"][2] == 3  # u's state had expired; the table keeps v


def test_first_and_latest_of_a_table(spark):
    rows = spark.createDataFrame([("u", "2024-01-01 10:00:00", 1), ("u", "2024-01-01 10:00:00", 2), ("u", "2024-01-01 09:00:00", 9), (None, "2024-01-01 09:00:00", 9), ("v", None, 1)], "user string, t string, n int").withColumn("ts", F.to_timestamp("t"))
    got = logs.first_and_latest(rows, "user", "ts", ["n"])
    assert [(r.user, str(r.first_seen), str(r.last_seen), r.n) for r in got.collect()] == [("u", "2024-01-01 09:00:00", "2024-01-01 10:00:00", 2)]
    assert logs.first_and_latest(rows.limit(0), "user", "ts", ["n"]).count() == 0


def test_documents_of_many_files(spark, tmp_path):
    path = tmp_path / "doc"
    rows = spark.range(0, 1000, 1, 7).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.concat(F.lit('a "quoted"\n'), "id")).alias("row"), F.col("id").alias("at"))
    files.write_document(rows, f"file://{path}")
    parts = sorted(path.glob("part-*"))
    got = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) == 7 and [r["k"] for r in got] == list(range(1000)) and got[1] == {"k": 1, "row": None, "at": 1} and got[3]["row"] == 'a "quoted"\n3'
    files.write_document(rows.limit(0), f"file://{path}")
    assert json.loads("".join(p.read_text() for p in path.glob("part-*"))) == []


def test_aliases_and_corpora(spark, tmp_path):
    (tmp_path / "aliases.json").write_text(json.dumps({"_doc": "x", "aliases": {"obtain": ["d:1", "d:2"], "erase": [], "keep": None}}))
    assert sorted(tuple(r) for r in files.read_aliases(spark, str(tmp_path / "aliases.json")).collect()) == [("obtain", "d:1", 0), ("obtain", "d:2", 1)]
    for name, row in (("a", {"k": 1, "source": "old"}), ("b", {"k": 2, "x": "only here"})):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps(row))
    got = files.read_corpora(spark, {n: str(tmp_path / f"{n}.jsonl") for n in "ab"})
    assert sorted((r.k, r.source, r.x) for r in got.collect()) == [(1, "a", None), (2, "b", "only here")]
