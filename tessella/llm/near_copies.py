"""Near copies by exact Jaccard similarity of word shingles.

Pairs are found without loss by a prefix filter: in any one order of all shingles, two sets of this
similarity share one of the first n - ceil(least * n) + 1 of each. The order is by hash, with
shingles that a sample of the texts shows to be frequent put last; the sample changes what the search
costs, never what it finds. Equal sets form one class, of which one row is compared. First SimHash (see
simhash) gives candidates, whose fingerprints over the sets differ in few bits; as 64 bits can't tell a similarity of
0.8 from a lower one, every class is compared with the hub of each shingle it shares too, the class that shares most
of its own, as the origin of many copies does. After joining what is linked, all that share a hub form a family, which
holds every pair that meets in one of its shingles; classes of one family and different components are compared in
the task that holds them, by sizes and parities (see parities), so that pairs that these rule out are nowhere rows.
Each candidate left is decided by its whole sets.

Defined cases: words are split at ASCII white space and compared in ASCII lower case. A text of fewer
words than a shingle has one, all of it; null, empty and blank texts have none and are equal. A long text is read whole, at about
60 bytes of a task's memory a byte. Of equal doc_ids the row scanned first stays; a null doc_id comes after all others. An empty table gives no rows.
Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import beside, shared, simhash
from . import textcols as tc
from .components import components

#: Frequent shingles that are put last, at most; 8 bytes each in every task.
FREQUENT = 1 << 20
#: Classes of one family that are compared in a task, at most.
CHUNK = 2048
#: Partners of one class that are compared in a task, about.
PARTNERS = 512
#: Rows a file of what is kept on the way, about, where one_of_each counts them.
ROWS = 5_000


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, ascending within each, and their bounds."""
    buf, offsets = tc.text_parts(column)
    buf = tc.LOWER[buf]
    starts, ends, bounds = tc.words(buf, offsets)
    h = tc.span_hashes(tc.prefix_hashes(buf), starts, ends)
    text = np.repeat(np.arange(len(column)), np.diff(bounds))
    grams = tc.gram_hashes(h, width)
    whole = np.flatnonzero(text[: len(grams)] == text[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < width))
    own = [int(tc.gram_hashes(h[bounds[d] : bounds[d + 1]], int(bounds[d + 1] - bounds[d]))[0]) for d in short.tolist()]
    grams, text = np.concatenate([grams[whole], np.array(own, np.uint64)]), np.concatenate([text[whole], short])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(column) + 1))


def _ratio(least: float) -> Fraction:
    return Fraction(least).limit_denominator(1000)


def _frequent(docs: DataFrame, width: int, share: int = 16, times: int = 8) -> np.ndarray:
    """Shingles of at least ``times`` of one in ``share`` texts, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column("text"), width)[0].view(np.int64))], names=["h"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit("order"), "_scan_row"), F.lit(share)) == 0).select("text")
    counts = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= times)
    return np.sort(counts.orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))


def read_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle sets of all texts, their bounds, and a hash of each set."""
    h, bounds = shingle_sets(column, width)
    at = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tc.mix(h), dtype=np.uint64)])
    return h, bounds, tc.mix(at[bounds[1:]] - at[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def parities(h: np.ndarray, bounds: np.ndarray, least: int = 1024) -> list[bytes]:
    """Of each set a bit for each cell of hashes, twice as many as shingles or more: whether it has an odd number there.

    Two sets differ in at least as many shingles as these differ in bits; see :func:`folded`.
    """
    n = np.diff(bounds)
    cells = 1 << np.ceil(np.log2(np.maximum(2 * n, least))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(cells)])
    text = np.repeat(np.arange(len(n)), n)
    place = first[text] + (tc.mix(h) & (cells[text] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(place, minlength=first[-1]) & 1).astype(bool)).tobytes()
    return [bits[a // 8 : b // 8] for a, b in itertools.pairwise(first.tolist())]


def folded(bits: list[bytes], size: int) -> np.ndarray:
    """Parities of one length as words of ``size`` bytes' cells, a power of two not above it."""
    x = np.frombuffer(b"".join(bits), np.uint64)
    return np.bitwise_xor.reduce(x.reshape(len(bits), -1, size // 8), axis=1)


def classes_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, _scan_row, node (a hash of the set), n, bits (the set's parities) and fp (its SimHash) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            h, bounds, node = read_sets(batch.column("text"), width)
            bits = pa.array(parities(h, bounds), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_scan_row"), pa.array(node), pa.array(np.diff(bounds)), bits, pa.array(simhash.majority(h, np.diff(bounds)).view(np.int64))], names=["doc_id", "_scan_row", "node", "n", "bits", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_scan_row", "text").mapInArrow(run, f"doc_id {kind}, _scan_row long, node long, n long, bits binary, fp long")


def _met(docs: DataFrame, width: int, least: float, files: int | None = None) -> DataFrame:
    """h and node of each prefix shingle that several classes have."""
    frequent, ratio = _frequent(docs, width), _ratio(least)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            h, bounds, node = read_sets(batch.column("text"), width)
            n = np.diff(bounds)
            text = np.repeat(np.arange(len(n)), n)
            h = h[np.lexsort((np.isin(h, frequent), text))]  # stable: by hash among the early and the late
            first = np.where(n > 0, n + (-n * ratio.numerator) // ratio.denominator + 1, 0)
            keep = np.flatnonzero(np.arange(len(h)) - np.repeat(bounds[:-1], n) < np.repeat(first, n))
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(node[text[keep]])], names=["h", "node"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, joined = np.zeros((0, 2), np.int64), False  # the row before, and whether one before it has its shingle
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            work = last if batch is None else np.concatenate([last, np.stack([batch.column(k).to_numpy() for k in ("h", "node")], 1)])
            if not len(work):
                continue
            new = np.ones(len(work), bool)
            new[1:] = (work[1:] != work[:-1]).any(1)
            work = work[new]
            same = work[1:, 0] == work[:-1, 0]
            keep = np.append(False, same) | np.append(same, False)
            keep[0] |= joined
            last, joined = work[-1:], keep[-1]
            keep[-1] &= batch is None
            yield pa.RecordBatch.from_arrays([pa.array(work[keep, 0]), pa.array(work[keep, 1])], names=["h", "node"])

    rows = docs.select("text").mapInArrow(prefixes, "h long, node long").repartition("h").sortWithinPartitions("h", "node")
    return shared.cut(rows.mapInArrow(groups, "h long, node long"), files)


def possible(pairs: DataFrame, classes: DataFrame, least: float, files: int | None = None) -> DataFrame:
    """Those of the pairs (u, v) whose sizes and parities allow the similarity, and in how many shingles they differ at least; no similar pair is lost."""
    ratio = _ratio(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = batch.column("bits_u").to_pylist(), batch.column("bits_v").to_pylist()
                n, m = batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy()
                differ = np.abs(n - m)  # at least
                sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)])
                for p, q in np.unique(sizes, axis=0).tolist():
                    at = np.flatnonzero((sizes == (p, q)).all(1))
                    x, y = (folded([z[k] for k in at.tolist()], min(p, q)) for z in (a, b))
                    differ[at] = np.maximum(differ[at], np.bitwise_count(x ^ y).sum(1, dtype=np.int64))
                # common = (n + m - differ) / 2 at most, and the union n + m - common
                good = (n + m - differ) * ratio.denominator >= (n + m + differ) * ratio.numerator
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(differ)], names=["u", "v", "differ"]).filter(pa.array(good))

    for k in ("u", "v"):
        pairs = pairs.join(classes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")), k)
    return shared.cut(pairs.select("u", "v", "n_u", "n_v", "bits_u", "bits_v").mapInArrow(run, "u long, v long, differ long"), files)


def alike(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, least: float, files: int | None = None) -> DataFrame:
    """Those of the pairs of classes (u, v) whose whole sets have the similarity; the set of v goes to that of u.

    The partners of a class are dealt into parts of about ``PARTNERS``, to each of which its set goes too.
    """
    spark, ratio = docs.sparkSession, _ratio(least)
    pairs = possible(pairs, classes, least, files)
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).alias("shares"))
    dealt = shared.cut(pairs.join(parts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("shares")).alias("share")), files)
    needed = dealt.select("u", "share", F.col("v").alias("node")).union(dealt.select("u", "share", "u").distinct())
    at = shared.fresh(spark, "classes")
    beside.store(needed.join(classes.select("node", F.col("_scan_row").alias("r")), "node").select("r", "u", "share", "node"), at)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = None
        for batch in tc.sub_batches(batches):
            r = batch.column("_scan_row").to_numpy()
            side = beside.stored(at, int(r[0])) if side is None else side
            rows, places = beside.rows_of(side, r)
            if len(rows):
                some, back = np.unique(places, return_inverse=True)
                h, bounds = shingle_sets(batch.column("text").take(pa.array(some)), width)
                own = [h[a:b].tobytes() for a, b in itertools.pairwise(bounds.tolist())]
                for k in range(0, len(rows), 256):
                    part = rows[k : k + 256]
                    u, node = side["u"][part], side["node"][part]
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(side["share"][part]), pa.array(node), pa.array(u != node), pa.array([own[x] for x in back[k : k + 256].tolist()], pa.binary())], names=["u", "share", "node", "later", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            u, v, later, s = (batch.column(k) for k in ("u", "node", "later", "s"))
            good = []
            for k, other in enumerate(later.to_pylist()):
                got = np.frombuffer(s[k].as_buffer(), np.uint64)
                if not other:
                    mine = got
                    continue
                common = len(np.intersect1d(mine, got, assume_unique=True))
                if common * ratio.denominator >= (len(mine) + len(got) - common) * ratio.numerator:
                    good.append(k)
            yield pa.RecordBatch.from_arrays([u.take(pa.array(good, pa.int64())), v.take(pa.array(good, pa.int64()))], names=["u", "v"])

    rows = docs.select("_scan_row", "text").mapInArrow(sets, "u long, share long, node long, later boolean, s binary").repartition("u", "share").sortWithinPartitions("u", "share", "later")
    out = shared.cut(rows.mapInArrow(compare, "u long, v long"), files)
    shared.remove(spark, at)
    return out


def _apart(n: np.ndarray, bits: list[bytes], component: np.ndarray, left: np.ndarray, right: np.ndarray, ratio: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a left and a right set, of different components, whose sizes and parities allow the similarity, and in how much they differ at least."""
    size, found = np.array([len(x) for x in bits]), []
    of = {p: np.flatnonzero(size == p) for p in np.unique(size).tolist()}
    for p, q in itertools.product(of, of):
        a, b = (np.intersect1d(of[k], side) for k, side in ((p, left), (q, right)))
        if not len(a) or not len(b):
            continue
        b = b[np.argsort(n[b], kind="stable")]
        x, y = (folded([bits[k] for k in rows.tolist()], min(p, q)) for rows in (a, b))
        lo = np.searchsorted(n[b] * ratio.denominator, n[a] * ratio.numerator, "left")
        hi = np.searchsorted(n[b] * ratio.numerator, n[a] * ratio.denominator, "right")
        for i, (s, e) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            near = s + np.flatnonzero(component[b[s:e]] != component[a[i]])
            m = n[b[near]]
            differ = np.maximum(np.bitwise_count(y[near] ^ x[i]).sum(1, dtype=np.int64), np.abs(m - n[a[i]]))
            # common = (n + m - differ) / 2 at most, and the union n + m - common
            good = (n[a[i]] + m - differ) * ratio.denominator >= (n[a[i]] + m + differ) * ratio.numerator
            found.append(np.stack([np.full(good.sum(), a[i]), b[near[good]], differ[good]], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return pairs[:, 0], pairs[:, 1], pairs[:, 2]


def _closest(low: np.ndarray, high: np.ndarray, differ: np.ndarray, best: int) -> np.ndarray:
    """The rows of each pair of components that differ least, ``best`` at most."""
    order = np.lexsort((differ, high, low))
    low, high = low[order], high[order]
    new = np.ones(len(order), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < best]


def across(families: DataFrame, classes: DataFrame, least: float, chunk: int, best: int | None = None, files: int | None = None) -> DataFrame:
    """Pairs (u, v) of classes of one family and different components that may be similar. families: hub, node and c, the component.

    With ``best`` only so many for each two components of a tile, those that differ least: links among them join components,
    before all other pairs are asked for.
    """
    ratio = _ratio(least)
    many = shared.cut(families.groupBy("hub").agg(F.count("*").alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("hub", F.ceil(F.col("k") / chunk).cast("int").alias("chunks")), files)
    dealt = families.join(many, "hub").join(classes.select("node", "n", "bits"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiles = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tiles = tiles.select("hub", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("right"), "node", "n", "bits", "c")
    tiles = tiles.repartition("hub", "a", "b").sortWithinPartitions("hub", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            hub, a, b, right, node, n, c = (table.column(k).to_numpy() for k in ("hub", "a", "b", "right", "node", "n", "c"))
            bits = table.column("bits").to_pylist()
            new = np.ones(len(hub) + 1, bool)
            new[1:-1] = (hub[1:] != hub[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            for s, e in itertools.pairwise(np.flatnonzero(new).tolist()):
                at = np.arange(e - s)
                one = a[s] == b[s]
                left, other = (at, at) if one else (at[~right[s:e]], at[right[s:e]])
                x, y, differ = _apart(n[s:e], bits[s:e], c[s:e], left, other, ratio)
                if best:
                    p, q = c[s:e][x], c[s:e][y]
                    some = _closest(np.minimum(p, q), np.maximum(p, q), differ, best)
                    x, y = x[some], y[some]
                u, v = node[s:e][x], node[s:e][y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = [table.column(k)[-1].as_py() for k in ("hub", "a", "b")] if table.num_rows else None
            same = np.logical_and.reduce([table.column(k).to_numpy() == x for k, x in zip(("hub", "a", "b"), last, strict=True)]) if last else np.zeros(0, bool)
            cut = int(np.argmax(same)) if len(same) else 0  # the last group may go on
            if cut >= 4096:
                yield from done(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))
        tc.release()

    return shared.cut(tiles.mapInArrow(run, "u long, v long").distinct(), files)


def links(rows: DataFrame, docs: DataFrame, width: int = 5, least: float = 0.8, chunk: int = CHUNK, radius: int = 4, files: int | None = None) -> DataFrame:
    """Links (u, v) that join all classes of rows whose similarity is at least ``least``; not all pairs. What is kept on the way has at most ``files`` files a table, if that is given."""
    classes = shared.cut(rows.groupBy("node").agg(F.min("_scan_row").alias("_scan_row"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp")), files)
    points = shared.cut(classes.groupBy("fp").agg(F.min("node").alias("node")), files)
    same = classes.select("fp", F.col("node").alias("v")).join(points.withColumnRenamed("node", "u"), "fp").select("u", "v")
    met = _met(docs, width, least, files)
    shares = met.groupBy("node").agg(F.count("*").alias("shares"))
    hubs = met.join(shares, "node").groupBy("h").agg(F.max_by("node", F.struct("shares", "node")).alias("hub"))
    family = shared.cut(met.select("h", "node").join(hubs, "h").select("hub", "node").distinct(), files)
    close = same.union(simhash.links(points, radius, files=files)).union(family.select(F.col("hub").alias("u"), F.col("node").alias("v")))
    stars = shared.cut(close.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), files)
    found = alike(stars, classes, docs, width, least, files)
    named = shared.cut(family.join(components(found, files=files), "node", "left").select("hub", "node", F.coalesce("root", "node").alias("c")), files)
    pairs = shared.cut(across(named, classes, least, chunk, files=files).join(stars, ["u", "v"], "left_anti"), files)
    return found.union(alike(pairs, classes, docs, width, least, files))


def one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """Of each group of rows linked by similarity the row with the smallest doc_id, one of equal ones; the texts stay where they are scanned.

    The input must be a table or a checkpoint.
    """
    tc.tune(docs.sparkSession)
    name = "_row"
    while name in docs.columns:
        name += "_"
    docs_at = beside.numbered(docs, name)
    narrow = docs_at.select("doc_id", "text", F.col(name).alias("_scan_row"))
    rows = shared.cut(classes_of(narrow, width))
    files = shared.files(rows.count(), ROWS)
    roots = components(links(rows, narrow, width, least, chunk, files=files), files=files)
    group, first = F.coalesce("root", "node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_scan_row"))
    best = rows.select("doc_id", "_scan_row", "node").join(roots, "node", "left").groupBy(group.alias("component")).agg(first.alias("first"))
    at = shared.fresh(docs.sparkSession, "kept")
    beside.store(best.select(F.col("first._scan_row").alias("r")), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = None
        for batch in batches:
            r = batch.column(name).to_numpy()
            if len(r):
                side = beside.stored(at, int(r[0])) if side is None else side
                yield batch.filter(pa.array(np.isin(r, side.get("r", r[:0])))).drop_columns([name])

    return docs_at.mapInArrow(run, docs.schema)
