"""Conversation repair, MinHash near-duplicates and whitening against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import conversations, minhash, near_copies, shared, whitening
from tessella.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def same_rows(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got[columns].astype(object).values.tolist())) == sorted(map(repr, want[columns].astype(object).values.tolist()))


@pytest.mark.parametrize("name", ["op11_repair", "op12_minhash"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same_rows(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df())


# ---- conversations


def damage(rows):
    """By the contract, row by row, in the stated order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def cheapest(rows):
    """All sequences of edits with up to two inserts at a place, tried in full."""
    faults, seen = [], set()
    for _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None

    def go(k, cost, audit, said, inserts):
        nonlocal best
        initials = "".join(r[:1] for r, _ in said)
        if not re.fullmatch(r"(s?(ua)*u?)?", initials) or any(not r for r, _ in said) or (best and cost > best[0]):
            return
        if k == len(rows) and (initials == "" or re.fullmatch(r"s?(ua)+", initials)):
            best = min(best or (10**9, "", []), (cost, audit, said))
        if inserts < 2:
            for role in ("user", "assistant"):
                go(k, cost + 5, audit + "I", [*said, (role, "")], inserts + 1)
        if k < len(rows):
            _, role, text = rows[k]
            go(k + 1, cost + 2, audit + "D", said, 0)
            if faults[k] not in ("blank", "duplicate"):
                more = 5 if faults[k] else 0
                go(k + 1, cost + more, audit + "K", [*said, (role, text)], 0)
                for new in ("user", "assistant"):
                    go(k + 1, cost + 1 + more, audit + "R", [*said, (new, text)], 0)

    go(0, 0, "", [], 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], digest), best[2]


TALK = "conv_id long, turn long, role string, text string, audit string, h long, cost double"


@pytest.fixture(scope="module")
def talk():
    draw, rows = random.Random(7), []
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "cut", " \n", "", None, "Why? \t", "été.", "a" * 9000 + "."]
    for conv in [None, *range(150)]:
        for _ in range(draw.randrange(1, 6)):
            rows.append((conv, draw.choice([None, 0, 1, 2, 3, 4, 9]), draw.choice(roles), draw.choice(texts), "x", 1, 0.5))
    return rows + rows[3:6]


def test_repair_is_the_cheapest(spark, talk):
    rows = spark.createDataFrame(talk, TALK).repartition(3)
    marked = conversations.damaged(rows)
    report = shared.cut(conversations.reports(marked))
    got = {r.conv_id: tuple(r)[1:] for r in report.collect()}
    new = {c: [] for c in got}
    for r in sorted(conversations.repaired(marked, report).collect(), key=lambda r: r.place):
        new[r.conv_id].append((r.role, r.text))
    assert set(got) == {r[0] for r in talk}
    for conv in got:
        want, said = cheapest(damage([r[:4] for r in talk if r[0] == conv]))
        assert got[conv] == want, conv
        assert new[conv] == said, conv


def test_repair_of_a_long_conversation_and_of_none(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(3000)]
    turns[1500] = (1, 1500, "tool", "turn 1500.")
    rows = spark.createDataFrame([*turns, *((2, k, "tool", f"{k}.") for k in range(600))], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversations.reports(rows).collect()}
    assert got[1].audit == "K" * 1500 + "R" + "K" * 1499 and got[1].cost == 1
    assert got[2].cost == 600 and got[2].audit == "R" * 600
    assert conversations.reports(rows.where("false")).count() == 0
    gone = conversations.reports(rows.withColumn("gone", F.lit(True))).collect()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# ---- MinHash


def test_all_signatures_within_the_distance_share_an_entry():
    draw = np.random.default_rng(1)
    for chunks, size in ((12, 4), (5, 5), (3, 6)):
        one = draw.integers(0, 1 << 16, (500, chunks * size)).astype(np.uint16)
        other = one.copy()
        for row in other:
            row[draw.permutation(chunks * size)[: 2 * chunks - 1]] ^= draw.integers(1, 1 << 16, 2 * chunks - 1).astype(np.uint16)
        a, b = (minhash.entries(x, chunks, size) for x in (one, other))
        assert (a == b).any(1).all()
        assert not (minhash.entries(one, chunks, size)[:-1] == a[1:]).any()
    assert minhash.layout(10**5, 0.8) == (13, 4) and minhash.layout(10**10, 0.8)[1] > 5 and minhash.layout(10, 1.0) == (1, 4)


def shingles(text, width=2):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)) if len(ws) >= width else frozenset([tuple(ws)] if ws else [])


def by_all_pairs(rows):
    """component_id of each row, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [(d, len(s), least.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 3])
def test_minhash_finds_what_all_pairs_give(spark, chunk, monkeypatch):
    monkeypatch.setattr(near_copies, "PARTNERS", 2 if chunk == 3 else 512)
    monkeypatch.setattr(minhash.links, "__defaults__", (chunk,))
    draw = random.Random(3)
    word = lambda: f"w{int(draw.paretovariate(0.6)) % 3000}"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "Été"), (8, "été"), (9, "a b c d e f"), (10, "a b c d e"), (None, "one two"), (None, None)]
    for family in range(14):
        base = [word() for _ in range(draw.choice([5, 11, 40, 300]))]
        for _ in range(draw.choice([1, 2, 12])):
            copy = [word() if draw.random() < draw.choice([0, 0.02, 0.05, 0.1]) else w for w in base]
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    rows += rows[20:24]
    path = shared.fresh(spark, "minhash")
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, sig string, node long, n long").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(by_all_pairs(rows), key=repr)
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_one_of_each_keeps_a_column_of_its_own_name(spark):
    path = shared.fresh(spark, "own")
    spark.createDataFrame([(1, "a b c d e f g", 5), (1, "a b c d e f g", 6), (None, "a b c d e f g", 7), (None, "x y", 8)], "doc_id long, text string, _row long").write.parquet(path)
    docs = spark.read.parquet(path)
    got = near_copies.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "x y"), (1, "a b c d e f g")]


# ---- whitening

VECTORS = "vec_id long, embedding array<double>, component string, x long, label int"


def check_whitening(rows, got, k):
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    want = (x * n - s) / n @ (q / np.sqrt(e))
    places = {}
    for at, (key, _) in enumerate(rows):
        places.setdefault(key, []).append(at)
    signs = {}
    assert len(got) == len(rows) * k
    for r in got:
        at = places[r.vec_id][0]
        j = r.component - 1
        assert r.n == n and r.deviation == sum(int(v) ** 2 for v in x[at] * n - s)
        assert abs(r.explained / (e[j] / np.trace(c.T @ c / n)) - 1) < 1e-9 and r.identity_error < 1e-9
        sign = signs.setdefault(j, np.sign(r.whitened * want[at, j]) if abs(want[at, j]) > 1e-3 else None)
        assert abs(abs(r.whitened) - abs(want[at, j])) < 1e-7
        if sign is None:
            del signs[j]
        elif abs(want[at, j]) > 1e-3:
            assert np.sign(r.whitened * want[at, j]) == sign


def test_whitening_by_eigenvectors(spark):
    draw = np.random.default_rng(5)
    for d, spread in ((24, np.linspace(1, 3, 24)), (80, 0.9 ** np.arange(80) * 20), (3, np.ones(3))):
        data = (draw.standard_normal((400, d)) * spread).tolist()
        rows = list(enumerate(data)) + [(1000, data[3]), (1001, data[3]), (None, data[5])]
        bad = [(2000, None), (2001, [1.0] * (d - 1) + [None]), (2002, [float("nan")] * d), (2003, [float("-inf")] + [0.0] * (d - 1)), (2004, [1.0]), (2005, [])]
        frame = spark.createDataFrame([(*r, "c", 1, 2) for r in rows + bad], VECTORS).repartition(3)
        check_whitening(rows, whitening.whiten(frame).collect(), min(16, d))


def test_subspace_iteration_without_all_dimensions(spark):
    draw = np.random.default_rng(6)
    data = np.floor(draw.standard_normal((300, 60)) * 0.7 ** np.arange(60) * 50_000).astype(np.int64)
    fit = shared.cut(spark.createDataFrame([(r,) for r in data.tolist()], "x array<long>").distinct())
    got = whitening.fit_whitening(fit, components=3, spare=5)
    e, q = np.linalg.eigh(np.cov(data.T, bias=True))
    assert np.allclose(got.values, e[::-1][:3], rtol=1e-12) and np.allclose(abs((got.components * q[:, ::-1][:, :3]).sum(0)), 1, atol=1e-12)


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.where("false")).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    far = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e13, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n, r.deviation) for r in whitening.whiten(far).where("component = 1").collect()} == {(1, 2, None), (2, 2, None)}


def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, QUERIES["op13_whitening"](spark, SF).collect(), 16)
