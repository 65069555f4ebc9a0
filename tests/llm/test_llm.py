"""The operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import attention, beside, components, decontaminate, langid, language_model, mixing, near_copies, quality, repetition, sampling, shared, simhash, stages, suffix_dedup, textcols, toxicity, warc
from tessella.llm.queries import ORACLE_SQL, QUERIES
from tessella.llm.sampling import fold

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, r long, component string"
LONG = " ".join(f"word{i % 977} the{i % 13}" for i in range(20_000))
TEXTS = [None, "", "   \n\t", "a", "été ÉTÉ naïve", "x y z " * 60, "The cat sat. " * 3, LONG, LONG, "one two three four five six seven eight nine ten eleven\n" * 2]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, None if i == 3 else "s", None, 1.0, 7, 8, "c") for i, t in enumerate(TEXTS)]
    rows.append(rows[5])
    path = shared.fresh(spark, "awkward")
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 6)) for i in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- text kernels


def thue_morse(steps):
    word = "a"
    for _ in range(steps):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("steps", [10, 12])
def test_no_hash_of_a_thue_morse_word_is_its_complements(spark, steps):
    word, other = thue_morse(steps)
    buf, n = np.frombuffer((word + other).encode(), np.uint8), len(word)
    h = textcols.span_hashes(textcols.prefix_hashes(buf), np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    docs = spark.createDataFrame([(1, f"{word}\n{other}"), (2, word), (3, other)], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in repetition.repetition_rules(docs).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.n_known for r in language_model.score_texts(docs, F.col("doc_id") == 2, steps=1).where("doc_id = 3").collect()} == {1}
    items = spark.createDataFrame([(1, other)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items, least_item=1).collect()} == {1, 3}
    path = shared.fresh(spark, "words")
    docs.where("doc_id > 1").write.parquet(path)
    seen = Counter(t[i : i + 200] for t in (word, other) for i in range(n - 199))
    want = sum(any(seen[t[j : j + 200]] > 1 for j in range(max(0, i - 199), min(i, n - 200) + 1)) for t in (word, other) for i in range(n))
    assert sum(r.n_removed for r in suffix_dedup.deduplicate(spark.read.parquet(path)).collect()) == want


def test_spans_and_hashes():
    column = pa.array(["ab  cd\n", None, "", " cd", "é"])
    buf, offsets = textcols.text_parts(column)
    starts, ends, bounds = textcols.words(buf, offsets)
    assert [bytes(buf[s:e]).decode() for s, e in zip(starts, ends)] == ["ab", "cd", "cd", "é"]
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1]
    h = textcols.span_hashes(textcols.prefix_hashes(buf), starts, ends)
    assert h[1] == h[2] and len(set(h.tolist())) == 3
    assert textcols.text_parts(column.slice(3))[0].tobytes() == " cdé".encode()


def test_every_operator_keeps_awkward_rows(spark, awkward, empty, labels):
    learn = F.col("doc_id") >= 0
    for run in (
        lambda d: quality.score_quality(d, labels, learn),
        lambda d: toxicity.score_toxicity(d, labels, learn),
        lambda d: langid.identify_languages(d, learn),
        repetition.repetition_rules,
        simhash.near_duplicates,
        lambda d: language_model.score_texts(d, learn, steps=3),
        suffix_dedup.deduplicate,
        mixing.mix_documents,
    ):
        assert run(awkward).count() == awkward.count()
        assert run(empty).count() == 0
    item = spark.createDataFrame([(1, None), (2, ""), (3, "word5 the5 word6 the6"), (3, LONG[:400])], "item_id long, text string")
    got = decontaminate.contaminated(awkward, item)
    assert {r.doc_id for r in got.collect()} == {7, 8}
    assert decontaminate.contaminated(empty, item).count() == 0 and decontaminate.contaminated(awkward, item.where("false")).count() == 0


def test_fallbacks_without_labels(spark, awkward, labels):
    none = labels.where("false")
    assert {r.score for r in quality.score_quality(awkward, none, F.lit(True)).collect()} == {0.5}
    assert all(r.score < 1e-6 and r.spans == [] for r in toxicity.score_toxicity(awkward, none, F.lit(True)).collect())
    assert {r.lang_pred for r in langid.identify_languages(awkward, F.lit(False)).collect()} == {"und"}


def test_undetermined_language(spark, awkward):
    got = [(r.doc_id, r.lang_pred) for r in langid.identify_languages(awkward, F.lit(True)).collect()]
    assert {d for d, lang in got if lang == "und"} == {0, 1, 2}


# ---- quality and toxicity


def test_rules_compile_to_the_model(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    rules, weights, bias = quality.fit_rules(x, y)
    p = 1 / (1 + np.exp(-(sum(w * quality.holds(r, x) for r, w in zip(rules, weights)) + bias)))
    assert ((p > 0.5) == y).mean() > 0.97
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = np.array([r[0] for r in df.select(quality.compile_rules(["a", "b", "c"], rules, weights, bias)).collect()])
    assert np.allclose(np.sort(got), np.sort(p))


def test_chain_learns_from_documents():
    rng = np.random.default_rng(15)
    n, length, size = 400, 12, 30  # feature 0 is toxic; 1 stands beside it and in clean windows
    ids = rng.integers(2, size, (n, length, 1))
    toxic = np.arange(n) % 2 == 0
    at = rng.integers(0, length - 1, n)
    for k in range(n):
        ids[k, at[k] + 1, 0] = 1
        if toxic[k]:
            ids[k, at[k], 0] = 0
    gold = np.isin(ids[:, :, 0], (0, 1)) & toxic[:, None]  # the first labels take both for toxic
    used = np.ones((n, length), bool)
    w, bias, trans = toxicity.fit_chain(ids, gold.astype(int), used, toxic, size, epochs=120)
    assert w[0] > w[1] + 1 and w[0] + bias > 0


def test_marginals_by_brute_force():
    rng = np.random.default_rng(1)
    trans, n = np.exp(rng.normal(size=(2, 2))), 300
    ratio, first = np.exp(rng.normal(size=n) * 2), rng.random(n) < 0.1
    first[0] = True
    got = toxicity.marginals(ratio, first, trans)
    edges = [*np.flatnonzero(first), n]
    for a, b in zip(edges[:-1], edges[1:]):
        e = np.stack([np.ones(b - a), ratio[a:b]], 1)
        alpha, beta = [e[0]], [np.ones(2)]
        for k in range(1, b - a):
            alpha.append((alpha[-1] @ trans) * e[k])
        for k in range(b - a - 1, 0, -1):
            beta.insert(0, trans @ (e[k] * beta[0]))
        p = np.array(alpha) * np.array(beta)
        assert np.allclose(got[a:b], p[:, 1] / p.sum(1), atol=1e-9)


@pytest.mark.parametrize(("query", "label", "parts", "rest", "least"), [("op1_quality", "quality", 3, 1, 0.9), ("op2_toxicity", "toxic", 5, 0, 0.85)])
def test_held_out_accuracy(spark, query, label, parts, rest, least):
    d = SF.replace("0.001", "0.01")
    got = QUERIES[query](spark, d).toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) for r in got.itertuples())
    m = got.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out & m[label].notna()]
    assert (m.predicted == m[label]).mean() >= least
    assert got.score.between(0, 1).all() and len(got) == spark.read.parquet(f"{d}/documents.parquet").count()


def test_held_out_languages(spark):
    d = SF.replace("0.001", "0.01")
    got = QUERIES["op3_language"](spark, d).toPandas().merge(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    got = got[got.held_out & got.lang.notna()]
    assert (got.lang == got.lang_pred).mean() > 0.97


# ---- repetition


def test_repetition_by_brute_force(awkward):
    for r in repetition.repetition_rules(awkward.where("doc_id is not null")).collect():
        ws = words(TEXTS[r.doc_id])
        grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        inside = {i + j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (TEXTS[r.doc_id] or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(ws), sum(map(len, ws)), len(inside), len(lines) - len(set(lines)))
        assert r.base_failed == (len(ws) < 10 or 100 * len(inside) > 20 * len(ws))


# ---- SimHash


def fingerprint(t):
    ws = [w.encode().lower() for w in words(t)]
    h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))] if ws else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints(awkward):
    for r in simhash.fingerprints(awkward.where("doc_id < 7")).collect():
        assert r.fp & (1 << 64) - 1 == fingerprint(TEXTS[r.doc_id])


def test_bit_planes():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    base[:60] = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    for radius in (0, 2, 3, 4, 7):
        got = simhash.near(base, simhash.planes(base), len(base), radius)
        assert (got == (np.bitwise_count(base[:, None] ^ base[None, :]) <= radius)).all()


@pytest.mark.parametrize("chunk", [4, 2048])
def test_components_of_links(spark, chunk):
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([fp, *(fp[k : k + 1] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 60)).astype(np.uint64)) for k in range(2))])
    fp = np.unique(fp)
    points = spark.createDataFrame([(int(x.astype(np.int64)), i) for i, x in enumerate(fp)], "fp long, node long")
    got = {r.node: r.root for r in components.components(simhash.links(points, 4, chunk)).collect()}
    root = list(range(len(fp)))
    for _ in fp:
        for i in range(len(fp)):
            for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4):
                root[i] = root[j] = min(root[i], root[j])
    assert [got.get(i, i) for i in range(len(fp))] == root


def test_shared_planes():
    rng = np.random.default_rng(12)
    for sizes in ([5, 2, 64, 3, 3, 1, 40] * 3, [2], [64, 64], [1, 1]):
        group = rng.permutation(np.repeat(np.arange(len(sizes)), sizes))
        fp = rng.integers(0, 1 << 63, len(group), dtype=np.uint64)
        for i in range(0, len(fp) - 1, 2):  # copies with a few bits changed
            fp[i + 1] = fp[i] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 9)).astype(np.uint64), initial=np.uint64(0))
        size = np.bincount(group)[group]
        for radius in (0, 3, 4):
            u, v = simhash._small_links(fp, np.arange(len(fp)), group, size, radius)
            want = {(i, j) for i in range(len(fp)) for j in range(i) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}
            assert {(max(p), min(p)) for p in zip(u.tolist(), v.tolist())} == want


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_any_blocks_find_all_links(spark, blocks):
    rng = np.random.default_rng(13)
    fp = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, *(fp ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, 30)).astype(np.uint64)) for _ in range(2))]))
    points = spark.createDataFrame([(int(x.astype(np.int64)), i) for i, x in enumerate(fp)], "fp long, node long")
    got = {r.node: r.root for r in components.components(simhash.links(points, 4, blocks=blocks)).collect()}
    root = list(range(len(fp)))
    for _ in fp:
        for i in range(len(fp)):
            for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4):
                root[i] = root[j] = min(root[i], root[j])
    assert [got.get(i, i) for i in range(len(fp))] == root


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n, 4) for n in (1_000, 10**6)] == [5, 6] and simhash.blocks_for(10**11, 4) > 6


def brute_components(ids, fps, radius=4):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return [min((ids[j] for j in range(len(ids)) if root[j] == r and ids[j] is not None), default=None) for r in root]


def test_component_ids_by_brute_force(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    big = 1 << 62
    rows = [(r.doc_id, r.text) for r in docs] + [(big + 9, "some words of a large id"), (big + 5, "some words of a large id"), (-7, docs[3].text), (None, docs[5].text), (None, "alone without an id"), (big + 6, None), (4, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [fingerprint(t) for _, t in rows]
    want = Counter(zip([d for d, _ in rows], [f"{f:016x}" for f in fps], brute_components([d for d, _ in rows], fps), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_unsettled_components_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long"), most_rounds=2)


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}


# ---- near copies


def shingles(t):
    ws = [w.encode().lower() for w in words(t)]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


@pytest.mark.parametrize("chunk", [2, 2048])
def test_near_copies_by_brute_force(spark, awkward, chunk):
    rng = np.random.default_rng(8)
    make = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    base, line = [make(int(n)) for n in rng.integers(30, 300, 25)], make(12)
    texts = [" ".join(b + line) for b in base] + [" ".join(make(4) + line * 2) for _ in range(12)] + [None, "", " ", "a b", "A  b", "a b c"]
    for b in base[:20]:
        for edits in (1, 2, 3, 5, 8, 12):
            copy = list(b)
            for at in rng.integers(0, len(b), max(1, edits * len(b) // 150)):
                copy[at] = f"x{rng.integers(9)}"
            texts.append(" ".join(copy + line))
    root = brute_groups(texts)
    path = shared.fresh(spark, "copies")
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(path)
    got = near_copies.one_of_each(spark.read.parquet(path), chunk=chunk)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))
    assert near_copies.one_of_each(awkward).count() == len(set(brute_groups(TEXTS)))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(11)
    for n, m in ((5, 9), (600, 700), (700, 2500), (9, 4000)):
        a = rng.choice(10_000, n, replace=False).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.choice(np.arange(20_000, 40_000), m - n // 2, replace=False).astype(np.uint64)])
        x, y = near_copies.parities(np.concatenate([a, b]), np.array([0, n, n + m]))
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(near_copies.folded([x], size) ^ near_copies.folded([y], size)).sum())
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))
        assert differ > (n + m) // 8 or m > 100 * n


def test_near_duplicates_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    root = brute_groups([t for _, t in rows])
    assert sorted(r.doc_id for r in stages.one_of_each_group(docs).select("doc_id").collect()) == sorted(rows[k][0] for k in set(root))


# ---- WARC


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "same"), (5, "http://b\r\nX: 1", "same"), (5, "http://b\r\nX: 1", "same"), (3, None, None), (4, "u", ""), (6, "é%0A", "été\r\n\r\nWARC/1.1" * 50), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    at = shared.fresh(spark, "warc")
    index = warc.write_archives(pages, at)
    back = warc.read_records(index, at).collect()
    want = Counter((str(p) if p is not None else None, u, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for p, u, h in rows)
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in back) == want
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in back)
    assert kinds == Counter({("1", "revisit", "5"): 1, ("5", "response", None): 1, ("5", "revisit", "5"): 1, (None, "revisit", "5"): 1, ("3", "revisit", "4"): 1, ("4", "response", None): 1, ("6", "response", None): 1})
    some = warc.read_records(index.where("url = 'http://a'"), at).collect()
    assert [r.page_id for r in some] == ["1"]
    assert warc.write_archives(pages.where("false"), shared.fresh(spark, "warc")).count() == 0


# ---- decontamination


def test_overlaps_tolerate_substitutions(spark):
    item = [f"w{i}" for i in range(30)]
    bent = [w if i % 9 else "zz" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(item).upper() + "."), (2, "c " + " ".join(bent)), (3, " ".join(item[:12])), (4, " ".join(item[3:18])), (5, "nothing here"), (6, "Short, item!")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "short item")], "item_id long, text string")
    for size in (1 << 20, 40):  # one slice, or several
        got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_substituted) for r in decontaminate.contaminated(docs, bench, slice_bytes=size, least_item=1).collect()}
        assert set(got) == {(1, 7), (2, 7), (4, 7), (6, 8)}
        assert got[1, 7] == (30, 0) and got[4, 7] == (15, 0) and got[2, 7] == (26, 2)
    assert {r.doc_id for r in decontaminate.clean(docs, bench, least_item=2).collect()} == {3, 5}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {3, 5, 6}  # two tokens are not looked for


def brute_overlaps(texts, items, least=13):
    """(text, item) of all that overlap, by all diagonals."""
    out = set()
    for d, a in enumerate(texts):
        for i, b in enumerate(items):
            for diagonal in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
                same = [a[k + diagonal] == b[k] for k in range(lo, hi)]
                if sum(same) and (brute_run(same, least) >= least or (hi - lo == len(b) and 5 * sum(same) >= 4 * len(b))):
                    out.add((d, i))
                    break
    return out


def test_overlaps_by_brute_force(spark):
    rng = np.random.default_rng(14)
    items = [[f"w{k}" for k in rng.integers(0, 40, n)] for n in (4, 6, 13, 16, 25, 30)] + [["ho"] * 20, ["a", "b"] * 12]
    texts = [[f"w{k}" for k in rng.integers(0, 40, 60)] for _ in range(20)] + [["ho"] * 300, ["a", "b"] * 150 + ["c"], ["b", "a", "x", "y"] * 9]
    for k, t in enumerate(texts[:20]):
        item = list(items[k % 6])
        for at in rng.integers(0, len(item), k % 4):
            item[at] = "zz"
        t[10 : 10 + len(item)] = item
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(0, " ".join(items[0]))], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_overlaps(texts, items)


def test_repeated_words_are_no_square(spark):
    index = decontaminate.Index(pa.array(["ho " * 1000, "a b " * 500]))
    for text in ("ho " * 20_000, "a b " * 10_000):
        assert len(decontaminate.overlaps(index, pa.array([text]), 13, 0.8)) == 1
        h, bounds = decontaminate.token_hashes(pa.array([text]))
        assert len(index.hits(h, bounds)) < 25_000


def brute_run(same, least, share=0.8):
    """The length of the longest run from a match to a match at the share, by all runs."""
    found = [e - s for s in range(len(same)) for e in range(s + 1, len(same) + 1) if same[s] and same[e - 1] and 5 * sum(same[s:e]) >= 4 * (e - s)]
    return max(found, default=0)


def test_longest_runs_by_brute_force():
    rng = np.random.default_rng(9)
    for n in [*range(1, 40)] * 5:
        same = rng.random(n) < rng.choice([0.6, 0.8, 0.9])
        s, e = decontaminate.longest_run(same, 0.8)
        assert e - s == brute_run(same.tolist(), 13)
        s, e = decontaminate.overlap_run(same, 13, 0.8, False)
        assert (e > s) == (brute_run(same.tolist(), 13) >= 13) and (e == s or 5 * same[s:e].sum() >= 4 * (e - s))
        s, e = decontaminate.overlap_run(same, 13, 0.8, True)
        assert (e > s) == (brute_run(same.tolist(), 13) >= 13 or 5 * same.sum() >= 4 * n)


def test_overlaps_with_spread_substitutions(spark):
    item = [f"w{i}" for i in range(16)]
    docs = spark.createDataFrame([(1, " ".join(["a", *item[:12], "zz", *item[13:], "b"])), (2, " ".join(["a", *item[:12], "b", "c", "d", "e"])), (3, "q " + " ".join(f"v{i}" for i in range(11)) + " zz")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(f"v{i}" for i in range(12)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_substituted) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 7): (16, 1), (3, 8): (12, 1)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2}


def missed(masks, n, k):
    """How many ways of k substitutions among n tokens leave no window for any mask."""
    picks = [sum(1 << i for i, c in enumerate(m) if c == "1") << at for m in masks for at in range(n - len(m) + 1)]
    bad = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), k)])
    return int(np.all([bad & p for p in picks], axis=0).sum())


def test_masks_miss_nothing():
    # an overlap of 26 tokens or more has a half of 13 or more that is as similar; 14 and 16 to 19 tokens hold 13 and 15
    # with no more substitutions, and so on
    for n, k in ((13, 2), (15, 3), (20, 4), (25, 5)):
        assert missed(decontaminate.MASKS, n, k) == 0
    for n in range(1, 13):
        assert missed(decontaminate.whole_masks(n, 0.8), n, n // 5) == 0
    assert missed(decontaminate.whole_masks(3, 0.5), 3, 1) == missed(decontaminate.whole_masks(2, 0.5), 2, 1) == 0


def test_substituted_items_are_all_met(spark):
    rng = np.random.default_rng(10)
    docs, items = [], []
    for k, n in enumerate([5, 9, 10, 12, 13, 13, 14, 15, 16, 20, 20, 25, 37, 54] * 12):
        item = [f"k{k}w{i}" for i in range(n)]
        bent = list(item)
        for at in rng.choice(np.arange(n), n // 5, replace=False) if k % 12 else range(4, n, 5):
            bent[at] = "zz"
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(["a", "b", *bent, "c"])))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    texts = {r.doc_id: r.text.split()[2:-1] for r in docs.collect()}
    want = {(k, k) for k, item in items if brute_run([a == b for a, b in zip(texts[k], item.split())], 13) >= 13 or 5 * sum(a == b for a, b in zip(texts[k], item.split())) >= 4 * len(item.split())}
    assert got == want and len(want) == len(items)


# ---- language model


def test_base_scores_by_brute_force(spark, awkward):
    held = fold("doc_id", 10) == 0
    got = language_model.score_texts(awkward.where("doc_id is not null"), ~held, steps=3, head=20).collect()
    rows = [(r.doc_id, [w.encode().lower() for w in words(r.text)] + [None]) for r in awkward.where("doc_id is not null").collect()]
    c = Counter(w for d, ws in rows if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((d, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for d, ws in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("joined", [False, True])
def test_model_is_causal_and_sums_to_one(joined):
    n, s = 12, attention.S
    net = attention.Model(n, np.arange(n) % 3, np.log(np.full(n, 0.25)), d=8, hidden=8)
    net.fold()
    rng = np.random.default_rng(4)
    ids = rng.integers(0, n - 1, 2 * s + 5).astype(np.int32)
    lengths = np.array([len(ids) - 3, 3])
    x, target, follows, text = attention.blocks(ids, lengths, n - 1)
    if joined:
        table = rng.random((n, n)).astype(np.float32)
        net.join(table / table.sum(1, keepdims=True), x, target, follows)
        assert 0 < net.partner[1] < 1
    lp = net.log_probs(x, target, follows)
    assert (target >= 0).sum() == len(ids) and (lp[target < 0] == 0).all()
    total = sum(np.exp(net.log_probs(x, np.full_like(target, k), follows)) for k in range(n))
    assert np.allclose(total, 1, atol=1e-4)
    x2 = x.copy()
    x2[1, 7:] = 0  # later inputs change no earlier score
    assert np.allclose(net.log_probs(x2, target, follows)[:2, :7], lp[:2, :7], atol=1e-5)
    x3 = x.copy()
    x3[2] = 1
    assert np.allclose(net.log_probs(x3, target, follows)[3], lp[3])  # nor do other texts


def test_training_lowers_the_loss():
    ids = np.tile(np.arange(8, dtype=np.int32), 400)
    x, target, follows, _ = attention.blocks(ids, np.array([len(ids)]), 8)
    net = attention.Model(9, np.arange(9) % 3, np.log(np.full(9, 1 / 3)), d=8, hidden=16)
    losses = net.fit(np.roll(x, 1, 0), x, target, follows, steps=120, batch=32)
    assert np.mean(losses[-10:]) < 0.5 * np.mean(losses[:10])


# ---- suffix-array deduplication


def brute_spans(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("width", "gram", "shards"), [(6, 2, 1), (6, 2, 3), (20, 5, 4), (300, 30, 2)])
def test_merged_transforms_by_brute_force(width, gram, shards):
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, n).astype(np.uint8).tobytes() for n in (90, 120, 40, 9, 77, 700)]
    texts += [texts[0][10:70] + b"\x00\xff" + texts[1][50:100], b"ab" * 60, b"\xff" * 400, b"", texts[5][90:600] + b"z" + texts[5][:350]]
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - width + 1) if count[t[i : i + width]] > 1}
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, start, n, a, _, s, w = suffix_dedup.segments(buf, offsets, width, gram)
    assert (n * w).sum() == sum(max(0, len(t) - width + 1) for t in texts)
    total = dict(zip(s.tolist(), np.bincount(np.unique(s, return_inverse=True)[1], w)[np.unique(s, return_inverse=True)[1]].astype(int).tolist(), strict=True))
    _, one = np.unique(s, return_index=True)  # equal segments are one row with their number
    strings = [texts[text[k]][start[k] : start[k] + n[k] + width - 1] for k in one]
    data, bounds = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in strings])])
    mark = suffix_dedup.repeated_windows(data, bounds, n[one], a[one], np.array([total[int(s[k])] for k in one]), width, gram, shards)
    of = {int(s[k]): mark[j] for j, k in enumerate(one)}
    got = {(int(text[k]), int(start[k] + j * n[k] + i)) for k in range(len(s)) for j in range(int(w[k])) for i in np.flatnonzero(of[int(s[k])]).tolist()}
    assert got == want


@pytest.mark.parametrize("most_segments", [1, 3, 1024])
def test_removal_by_brute_force(spark, most_segments):
    rng = np.random.default_rng(6)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = make(40)
    texts = [make(80) for _ in range(12)] + [make(20) + passage + make(30) for _ in range(6)] + [make(50) + "ho " * 90 + make(10), "é" * 300, "", None, "short", passage]
    texts += [texts[0], texts[1][:250] + "!" + texts[1][251:]]
    path = shared.fresh(spark, "texts")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(spark.read.parquet(path), most_segments=most_segments, text=True).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(raw, brute_spans(raw, 200))):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
        assert got[i].text == kept.decode(errors="ignore")


def test_repeated_passages_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    raw = [(r.text or "").encode() for r in rows]
    want = {r.doc_id: np.frombuffer(t, np.uint8)[~gone].tobytes().decode(errors="ignore") for r, t, gone in zip(rows, raw, brute_spans(raw, 200), strict=True)}
    got = stages.cut_repeats(docs).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


# ---- mixing


def test_raked_marginals_meet_targets():
    rng = np.random.default_rng(7)
    cells = {"source": np.repeat(["a", "b"], 6), "lang": np.tile(["x", "y", "z"], 4), "topic": np.tile(["p", "p", "p", "q", "q", "q"], 2)}
    tokens = rng.integers(10, 1000, 12).astype(float)
    goals = {k: mixing.target_shares(v, tokens, 0.3) for k, v in cells.items()}
    share, gap = mixing.rake(cells, tokens, goals)
    assert gap < 1e-8
    for k, goal in goals.items():
        for name, want in goal.items():
            assert abs(share[cells[k] == name].sum() - want) < 1e-8
    p = mixing.probabilities(share, tokens, 0.4 * tokens.sum())
    assert abs((p * tokens).sum() - 0.4 * tokens.sum()) < 1e-6 and p.max() <= 1
    assert mixing.probabilities(share, tokens, 1e12).min() == 1


def test_targets_that_contradict_are_told():
    cells = {"source": np.array(["a", "b"]), "lang": np.array(["x", "y"])}
    with pytest.warns(UserWarning, match="can't all be met"):
        _, gap = mixing.rake(cells, np.array([5.0, 5.0]), {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}})
    assert gap > 0.1


def test_mixture_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = mixing.mix_documents(docs, {"source": 0.0}, keep=0.4, topic=F.col("doc_id") % 3).collect()
    tokens, cells = np.array([r.n_tokens for r in rows], float), {k: np.array([r[k] for r in rows]) for k in ("source", "lang", "topic")}
    assert sorted(r.n_tokens for r in rows) == sorted(len(words(r.text)) for r in docs.collect())
    weight = np.array([r.weight for r in rows])
    for k, power in (("source", 0.0), ("lang", 0.7), ("topic", 0.7)):
        names, at = np.unique(cells[k], return_inverse=True)
        seen = np.bincount(at, tokens) / tokens.sum()
        got = np.bincount(at, weight * tokens) / (weight * tokens).sum()
        assert np.allclose(got, seen**power / (seen**power).sum(), atol=1e-6)
    p = np.array([r.probability for r in rows])
    assert abs((p * tokens).sum() - 0.4 * tokens.sum()) < 1e-3 * tokens.sum() and ((p == 1) | (weight * p.min() / weight.min() <= 1 + 1e-9)).all()
    drawn = [int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48 < r.probability for r in rows]
    assert drawn == [r.sampled for r in rows]


def test_mixture_of_awkward_rows(awkward):
    rows = mixing.mix_documents(awkward).collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    assert len({(r.probability, r.sampled) for r in rows if r.doc_id == 5}) == 1


# ---- queries and pipeline


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    key = sorted(got.columns)
    clean = lambda d: sorted(map(repr, d[key].astype(object).where(d[key].notna(), None).values.tolist()))
    assert key == sorted(want.columns) and clean(got) == clean(want)


def test_stages_on_awkward_rows(spark, awkward, empty, labels):
    bench = spark.createDataFrame([(1, None), (2, "word5 the5 word6 the6")], "item_id long, text string")
    runs = {"toxic": lambda d: stages.drop_toxic(d, labels), "copies": stages.one_of_each_group, "repeats": stages.cut_repeats, "leaks": lambda d: stages.drop_contaminated(d, bench), "mixture": stages.sample_mixture}
    for name, run in runs.items():
        got = run(awkward)
        assert got.columns[:5] == list(stages.COLUMNS) and got.columns[5:] == (["weight", "probability"] if name == "mixture" else [])
        assert run(empty).count() == 0
        if name == "repeats":
            assert got.count() == awkward.count()
        if name == "leaks":
            assert sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == sorted(r.doc_id for r in awkward.where("doc_id is not null").collect() if r.text != LONG)
    assert runs["copies"](awkward).where("doc_id = 7").count() + runs["copies"](awkward).where("doc_id = 8").count() == 1
    nothing = labels.where("false")
    assert stages.drop_toxic(awkward, nothing).count() == awkward.count()


def test_pipeline_of_nothing(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"word{k % 50_021} and" for k in range(1_300_000))  # about 20 MB
    path = shared.fresh(spark, "long")
    spark.createDataFrame([(1, text), (2, text[5_000_000:5_000_400]), (3, "short")], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicate(docs).collect()}
    assert got[1] == (len(text), len(text)) and got[2] == (400, 400) and got[3] == (5, 0)  # it repeats itself every 50,021 words
    assert {r.doc_id: r.n_words for r in repetition.repetition_rules(docs).collect()}[1] == 2_600_000
    assert {r.doc_id for r in decontaminate.contaminated(docs, spark.createDataFrame([(9, text[6_000_003:6_000_200])], "item_id long, text string")).collect()} >= {1}


def test_bounded_sample(spark):
    rows = spark.range(5000).selectExpr("id", "id % 10 = 0 as label").union(spark.range(30).selectExpr("7 as id", "true as label"))
    got = sampling.bounded_sample(rows, "id", "label", 200).collect()
    assert sum(r.label for r in got) == 200 == sum(not r.label for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, sampling.bounded_sample(rows.repartition(7), "id", "label", 200).collect()))
    assert len(sampling.bounded_sample(rows, "id", "label", 200, 100).collect()) == 100


def test_reads_are_dealt_by_bytes(spark):
    pages = spark.range(40).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 100) as html")
    path = shared.fresh(spark, "pages")
    pages.write.parquet(path)
    at = shared.fresh(spark, "warc")
    index = warc.write_archives(spark.read.parquet(path), at)
    many = index.withColumn("length", F.col("length") + 200_000_000)  # as if records were large
    assert warc.read_records(many, at).rdd.getNumPartitions() >= 30
    assert warc.read_records(index, at).count() == 40


def test_pipeline_by_stage(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = [set(before)]
    for name, stage in corpus_pipeline.STAGES:
        path = shared.fresh(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert seen[-1] <= seen[-2]
        if name == "near_duplicates":  # no two of those that stay are linked, and each that went is linked to some
            fp = {d: fingerprint(before[d]) for d in seen[-2]}
            kept = np.array([fp[d] for d in seen[-1]], np.uint64)
            assert (np.triu(np.bitwise_count(kept[:, None] ^ kept[None, :]) <= 4, 1)).sum() == 0
        if name == "decontamination":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert seen[3] == seen[2]
    import pathlib

    at = pathlib.Path(shared.folder(spark).removeprefix("file://"))
    there = {p.name for p in at.iterdir() if p.name.startswith(("repeats-", "kept-", "classes-"))}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == seen[-1]
    assert {p.name for p in at.iterdir() if p.name.startswith(("repeats-", "kept-", "classes-"))} == there  # nothing is left behind


def test_side_rows(spark, awkward):
    rows = beside.numbered(awkward.select("doc_id")).select("r", (F.col("doc_id") * 2).alias("v"))
    at = shared.fresh(spark, "side")
    beside.store(rows, at)
    r = rows.orderBy("r").first()["r"]
    side = beside.stored(at, r)
    assert (side["r"] >> 33 == r >> 33).all() and beside.stored(at, 99 << 33) == {}


def test_stage_of_short_texts(spark, awkward):
    assert stages.cut_repeats(awkward).where("doc_id = 7").first().text == ""
