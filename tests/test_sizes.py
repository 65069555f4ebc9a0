"""What must not grow with a session's settings or faster than the input, on small fixtures."""

from pathlib import Path

import pyarrow as pa
import numpy as np
from pyspark.sql import functions as F

from tessella import storage
from tessella.llm import attention, components, shared, stages
from tessella.functions import predicates
from tessella.operators import evaluate, gold, matching, passes, verify, xref
from tessella.plans import corpus


def test_few_links_are_held_in_few_partitions(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)] + [(1, 2), (3, 9)], "u long, v long")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = components.components(links)
        assert out.rdd.getNumPartitions() <= components.LEAST
        got = {r.node: r.root for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [got[k] for k in (1, 2, 3, 8, 9, 59)] == [0, 0, 0, 0, 0, 58]


def test_small_tables_of_the_pipeline_are_few_files(spark, monkeypatch, tmp_path):
    words = [f"w{i * 7919 % 1009}" for i in range(400)]
    texts = [" ".join(words[40 * k : 40 * k + 60]) for k in range(8)]
    rows = [(i, texts[i % 8] + (" more" if i % 3 else ""), "en", "web", 0) for i in range(48)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    cut, remove, parts, files = shared.cut, shared.remove, [], []
    monkeypatch.setattr(shared, "cut", lambda *a: (out := cut(*a), parts.append(out.rdd.getNumPartitions()))[0])
    count = lambda at: len(list(Path(at.removeprefix("file://")).glob("part-*")))
    monkeypatch.setattr(shared, "remove", lambda spark, *at: (files.extend(count(f"{x}/{k}") for x in at for k in ("kinds", "groups", "merged")), remove(spark, *at)))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        kept = sorted(r.doc_id for r in stages.one_of_each_group(docs).collect())
        left = {r.doc_id: r.n_chars for r in stages.cut_repeats(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == list(range(8)) and len(left) == 48 and max(left.values()) < 20
    assert max(parts) <= 12 and 0 < max(files) <= 12


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "DEALT", 10)
    assert storage.parts(spark, 5) == 4 and storage.parts(spark, 95) == 10
    expected, found = spark.range(100), spark.range(50, 150)
    out = evaluate.completeness(expected, found)
    assert out.rdd.getNumPartitions() >= 20
    assert {r.problem: r.n for r in out.groupBy("problem").agg(F.count("*").alias("n")).collect()} == {"missing": 50, "extra": 50}


def test_wobble_holds_no_distinct_values(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, ""), ("b", 1, "x"), ("b", 1, "y"), ("c", 1, "x"), ("c", 3, None), ("d", None, "x"), ("d", 1, "z")], "slot string, run int, value string").withColumn("field", F.lit("f"))
    out = evaluate.wobble(rows)
    assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString() and "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("f", 2, 1)]


def test_repeated_texts_give_their_citations_each_time(spark):
    rows = [("gdpr", f"u{i}", i, ["Articles 3 to 5", None, "", "see Article 7(1)", "none"][i % 5]) for i in range(40)]
    want = sorted((r[1], r[2], x[0], x[1], x[6]) for r in rows for x in xref.references(r[3]))
    frame = spark.createDataFrame(rows, "source string, unit_id string, paragraph_index int, text string").coalesce(1)
    got = sorted((r.unit_id, r.paragraph_index, r.place, r.raw, r.unit_number) for r in xref.extract(frame).collect())
    assert got == want


def test_unlike_sets_that_share_a_rare_token_are_no_rows(spark, monkeypatch):
    rows = [(i, "en", [f"r{i // 2}", *(f"w{i}_{k}" for k in range(3 if i % 4 < 2 else 1))]) for i in range(40)]
    rows += [(100 + i, "en", [f"s{k}" for k in range(10 + i)]) for i in range(8)]
    frame = spark.createDataFrame(rows, "id long, lang string, tokens array<string>")
    sets = {r[0]: set(r[2]) for r in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    for cells in (64, 512):
        monkeypatch.setattr(matching, "CELLS", cells)
        out = matching.similar_pairs(frame, ["lang"], "id", 0.5)
        assert {(r.a, r.b) for r in out.collect()} == want
    assert "bit_count" in out._jdf.queryExecution().optimizedPlan().toString()


def test_logits_above_the_bound_are_cut_as_before():
    net = attention.Model(12, np.arange(12) % 3, np.log(np.full(12, 0.25)))
    rng = np.random.default_rng(1)
    x, target = rng.integers(0, 12, (2, 5, attention.S))
    for scale in (1, 400):
        net.p["w2"] = net.p["w2"] * np.float32(scale)
        net.fold()
        got = net.log_probs(x, target, np.arange(5) > 0)
        each = np.stack([net.log_probs(x, np.full_like(x, t), np.arange(5) > 0) for t in range(12)])
        assert np.isfinite(got).all() and np.allclose(np.exp(each.astype(float)).sum(0), 1, atol=1e-3)
        assert np.allclose(np.take_along_axis(each, target[None], 0)[0], got, atol=1e-5)


def test_a_chunk_takes_its_logarithms_at_once(monkeypatch):
    net = attention.Model(60, np.arange(60) % 20, np.log(np.full(60, 1 / 3)))
    net.fold()
    rng, calls = np.random.default_rng(2), []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(np, name)

    monkeypatch.setattr(attention, "np", Counted())
    got = net.log_probs(*rng.integers(0, 60, (2, 200, attention.S)), np.arange(200) % 4 > 0)
    assert np.isfinite(got).all() and got.max() < 0
    assert calls.count("log") == 1 and calls.count("ones") == 0


def test_replay_rewrites_each_statement_once(spark):
    one = lambda v: F.array(corpus._one(F.lit(v)))
    modality = F.when(F.col("id") % 2 == 0, "OBLIGATION").otherwise("DISPENSATION")
    rows = corpus._statements(spark.range(8), source=F.lit("gdpr"), unit_type=F.lit("article"), paragraph_iri=F.concat(F.lit("gdpr:art_"), F.expr("string(id div 2)")), emission=F.col("id"), statement_class=F.lit("DEONTIC"), modality=modality, subject=one("The data controller"), predicate=one("shall process"), object=one("data"), condition=corpus._one(F.lit("where asked")))
    out = passes.replay(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "refrain" not in plan  # neither the input nor the rewriting of predicates is left in it
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    got = {(r.paragraph_iri, r.emission): (r.statement_id[-3:], r.merged_exception_split.dropped_condition) for r in out.collect()}
    assert got == {(f"gdpr:art_{i}", 2 * i): ("#s1", "where asked") for i in range(4)}


def test_a_predicate_is_worked_out_once_in_its_expression(spark):
    text = str(predicates.normalised(F.col("x"), F.col("m"))._jc.toString())
    assert text.count("regexp_replace(trim(x)") <= 2


def test_sides_of_many_patterns_meet_in_one_shuffle(spark, monkeypatch):
    word = ["OBLIGATION", "PROHIBITION", "PERMISSION"]
    s = spark.createDataFrame([(f"s{i}", "DEONTIC", word[i % 3], f"r{i % 4}:art_{i}", i == 0) for i in range(24)], "id string, statement_class string, modality string, paragraph_iri string, synthetic boolean")
    slots = spark.createDataFrame([(f"s{i}", rel, c) for i in range(24) for rel, c in (("OBJECT", f"c{i % 5}"), ("SUBJECT", "c9"), ("PREDICATE", f"c{i % 7}"))], "id string, rel string, iri string")
    broader = spark.createDataFrame([("c1", "c0"), ("c2", "c1"), ("c8", "c9")], "child string, parent string")
    rows = [(f"p{k // 2}", f"r{k % 4}:", [word[k % 3], word[(k + 1) % 3]], [f"c{k % 7}"], f"r{(k + 1) % 4}:", [word[k % 3]], ["c0", "c9"]) for k in range(80)]
    patterns = spark.createDataFrame(rows, "pattern string, a_regulation string, a_modalities array<string>, a_concepts array<string>, b_regulation string, b_modalities array<string>, b_concepts array<string>")
    shuffled, stored = [], verify.storage.stored
    monkeypatch.setattr(verify.storage, "stored", lambda df: (shuffled.append(df._jdf.queryExecution().sparkPlan().toString()), stored(df))[1])
    out = verify.conflict_sides(verify.Graph(s, slots, None, None, broader), patterns)
    above = {f"c{i}": {f"c{i}"} for i in range(10)} | {"c1": {"c1", "c0"}, "c2": {"c2", "c1", "c0"}, "c8": {"c8", "c9"}}
    want = {}
    for name, *ends in rows:
        for side, (reg, mods, concepts) in (("a", ends[:3]), ("b", ends[3:])):
            want.setdefault((name, side), set()).update(f"s{i}" for i in range(24) if f"r{i % 4}:" == reg and word[i % 3] in mods and (above[f"c{i % 5}"] | above[f"c{i % 7}"]) & set(concepts))
    none = {"a": "b", "b": "a"}
    told = {(p, e, i, len(want[p, none[e]])) for (p, e), ids in want.items() for i in ids if want[p, none[e]]}
    assert told and {tuple(r) for r in out.collect()} == told
    assert "SortMergeJoin" not in "".join(shuffled)


def test_references_to_one_target_are_no_group(spark, monkeypatch):
    monkeypatch.setattr(gold, "OFTEN", 20, raising=False)
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    rows = [(f"s{i}", at, t) for i in range(400) for at, t in ((0, "far" if i % 2 else "r7"), (1, f"r{i % 11}"), (2, None))]
    refs = spark.createDataFrame(rows, "id string, at int, target string").where("target is not null or id < 's2'")
    ids = spark.createDataFrame([(f"r{i}", f"g{i}") for i in range(9)], "run_id string, gold_id string")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = gold.translated(refs, ids)
        largest = max(out.rdd.glom().map(len).collect())
        got = sorted((r.id, r.at, r.target or "") for r in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    to = {f"r{i}": f"g{i}" for i in range(9)}
    want = sorted((i, at, to.get(t, t) or "") for i, at, t in rows if t is not None or i < "s2")
    assert got == want and largest < len(want) / 4


def test_pairs_of_an_article_take_one_shuffle(spark, monkeypatch):
    word, held = ["OBLIGATION", "PROHIBITION"], {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    rows = [(f"s{i:02}", word[i % 2], f"r:art_{i % 3}/par_{i % 4}{'/pt_a' * (i % 5 == 0)}", [["a b", "c"], ["b a c"], []][i % 3], [f"x{i % 2}", f"y{i % 6}", "all"][: i % 4], [f"p{i % 2}"], [f"o{i % 3}"][: i % 7]) for i in range(36)]
    s = spark.createDataFrame([(r[0], "DEONTIC", r[1], r[2], r[3], False) for r in rows], "id string, statement_class string, modality string, paragraph_iri string, conditions array<string>, synthetic boolean")
    slots = spark.createDataFrame([(r[0], rel, c) for r in rows for rel, cs in zip(("SUBJECT", "PREDICATE", "OBJECT"), r[4:]) for c in cs], "id string, rel string, iri string")
    sets = spark.createDataFrame([(r[0], *map(sorted, r[4:]), []) for r in rows], "id string, subjects array<string>, p array<string>, o array<string>, more array<string>")
    plain, both = verify.Graph(s, slots, None, None, None), verify.Held(s, slots, None, None, None)
    both.held = s.join(sets, "id").localCheckpoint()
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] == y[1] and x[2].split("/par_")[0] == y[2].split("/par_")[0] and set(x[4]) & set(y[4]):
                child = x[0] if x[2].startswith(y[2] + "/pt_") else y[0] if y[2].startswith(x[2] + "/pt_") else None
                p, o, (c, d) = x[5] == y[5], bool(x[6]) and x[6] == y[6], (set(" ".join(z[3]).split()) - {"a"} for z in (x, y))
                alike = 2 * len(c & d) >= len(c | d)
                want.add((x[0], y[0], x[1], "specialisation" if child else "duplicate_candidate" if p and o and alike else "none", child, p, o))
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for g in (plain, both):
            out = verify.redundancies(g)
            got = [tuple(r) for r in out.collect()]
            assert len(got) == len(set(got)) and set(got) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("+- Exchange hashpartitioning") == 1 and "ReusedExchange" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"specialisation", "duplicate_candidate", "none"} == {r[3] for r in want}
    without = verify.without_synthetic(both._replace(refs=spark.createDataFrame([], "id string, target string"), sources=spark.createDataFrame([], "id string, provision string")))
    assert without.held is None and verify.redundancies(without).count() == len(want)
