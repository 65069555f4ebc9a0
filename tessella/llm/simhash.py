"""Near-duplicate detection by SimHash with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` of 64 bits are linked. Cut into blocks, two such fingerprints agree
in all blocks but ``radius``; each choice of that many is a bucket table, and only fingerprints of one bucket are
compared. The number of blocks follows the number of fingerprints, so that buckets stay small; it changes what the
search costs, not what it finds. A large bucket is dealt into chunks and every pair of chunks into a task of its own.

All distances are counted in vertical bit planes: a carry-save counter sums the differing bits of 64 pairs a word.
In a large bucket 64 fingerprints at a time meet the planes of all; small buckets lie end to end in shared planes,
which meet themselves shifted by one place, two and so on. Words all of whose counts exceed the radius are
abandoned. A bucket gives spanning links, not all pairs.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other.
Repeated rows have the same fingerprint and component. Rows with a null doc_id are compared too;
their component is the smallest doc_id reachable, or null if there is none; doc_ids may be any numbers. A long text
is hashed whole, at about 60 bytes of a task's memory a byte. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as tc
from . import shared
from .components import components

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def text_fingerprints(column: pa.Array, width: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text over its shingles of ``width`` words, repeats included."""
    buf, offsets = tc.text_parts(column)
    low = tc.LOWER[buf].tobytes()
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(column), np.int64)
    for d in range(len(column)):
        ws = low[offsets[d] : offsets[d + 1]].split()
        if not ws:
            continue
        joined = b" ".join(ws)
        n = max(len(ws) - width + 1, 1)
        counts[d] = n
        if n == 1:
            hashes.append(digest(joined, seed))
            continue
        ends = list(itertools.accumulate(len(w) + 1 for w in ws))
        starts = [0, *ends[: n - 1]]
        hashes += [digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :], strict=True)]
    return majority(np.array(hashes, np.uint64), counts)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each group's hashes, which stand end to end; 0 for a group of none."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        ones = np.zeros((len(full), 64), np.int64)
        for byte in range(8):
            bits = np.unpackbits(((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            for k in range(8):
                ones[:, 8 * byte + k] = np.add.reduceat(bits[:, k], first, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and fp, the fingerprint as a signed long, of each row."""
    tc.tune(docs.sparkSession)
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(text_fingerprints(batch.column("text")).view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: word w of plane b holds bit b of the fingerprints 64 w to 64 w + 63; spare places repeat the last."""
    size = -(-len(fp) // 64) * 64
    fp = np.append(fp, np.full(size - len(fp), fp[-1]))
    bits = np.unpackbits(fp.view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _count(counter: list[np.ndarray], far: np.ndarray, carry: np.ndarray) -> None:
    """Adds a plane of bits to the counter; what it can't hold sticks as too far."""
    for c in counter:
        new = c & carry
        c ^= carry
        carry = new
    far |= carry


def near(query: np.ndarray, stored: np.ndarray, n: int, radius: int, check_every: int = 8) -> np.ndarray:
    """Whether each query is within the radius of each of the n fingerprints in the planes."""
    shape = (len(query), stored.shape[1])
    counter = [np.zeros(shape, np.uint64) for _ in range(max(1, int(radius).bit_length()))]
    far = np.zeros(shape, np.uint64)
    for b in range(64):
        flip = np.where((query >> np.uint64(b)) & np.uint64(1), _ALL, np.uint64(0))[:, None]
        _count(counter, far, stored[b][None, :] ^ flip)
        if b % check_every == check_every - 1 and ((far | _above(counter, radius)) == _ALL).all():
            return np.zeros((len(query), n), bool)
    over = far | _above(counter, radius)
    return np.unpackbits((~over).view(np.uint8).reshape(len(query), -1), axis=1, bitorder="little")[:, :n].astype(bool)


def near_on(stored: np.ndarray, apart: int, wanted: np.ndarray, radius: int, check_every: int = 8) -> np.ndarray:
    """The places, of the wanted ones, whose fingerprint is within the radius of that ``apart`` places on."""
    size = -(-len(wanted) // 64)
    mask = np.packbits(np.append(wanted, np.zeros(size * 64 - len(wanted), bool)), bitorder="little").view(np.uint64)
    at = np.flatnonzero(mask)
    skip, shift = apart // 64, np.uint64(apart % 64)
    last = stored.shape[1] - 1
    counter, far = [np.zeros(len(at), np.uint64) for _ in range(max(1, int(radius).bit_length()))], np.zeros(len(at), np.uint64)
    for b in range(64):
        row = stored[b]
        ahead = row[np.minimum(at + skip, last)] >> shift
        if shift:
            ahead |= row[np.minimum(at + skip + 1, last)] << (np.uint64(64) - shift)
        _count(counter, far, row[at] ^ ahead)
        if b % check_every == check_every - 1:
            alive = np.flatnonzero(~(far | _above(counter, radius)) & mask[at])
            if len(alive) < len(at):
                at, far, counter = at[alive], far[alive], [c[alive] for c in counter]
                if not len(at):
                    break
    out = np.zeros(size, np.uint64)
    out[at] = ~(far | _above(counter, radius)) & mask[at]
    return np.flatnonzero(np.unpackbits(out.view(np.uint8), bitorder="little")[: len(wanted)])


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the count in the bit planes exceeds the radius."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], _ALL)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest of its component, for the edges of one batch."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _bucket_links(fp: np.ndarray, node: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links in one large bucket or between two chunks of one (side 0 and 1)."""
    label = np.arange(len(fp))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    if len(left) == 0:
        return node[:0], node[:0]
    stored = planes(fp[right])
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        close = near(fp[rows], stored, len(right), radius)
        for i, hit in zip(rows, close, strict=True):
            found = np.unique(np.append(label[right[hit]], label[i]))
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    moved = label != np.arange(len(fp))
    return node[moved], node[label[moved]]


def _small_links(fp: np.ndarray, node: np.ndarray, bucket: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in many small buckets; size: of each row's bucket."""
    order = np.lexsort((bucket, -size))  # the rows of buckets larger than any size come first
    fp, node, bucket, size = fp[order], node[order], bucket[order], size[order]
    u, v = [node[:0]], [node[:0]]
    stored = planes(fp) if len(fp) else None
    for apart in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -apart, "left")) - apart
        at = near_on(stored, apart, bucket[:n] == bucket[apart : n + apart], radius)
        u.append(node[at])
        v.append(node[at + apart])
    return np.concatenate(u), np.concatenate(v)


def blocks_for(n: int, radius: int) -> int:
    """The number of blocks for which n fingerprints take least work: rows of tables, and comparisons in their buckets."""
    work = lambda b: math.comb(b, radius) * (1 + n / 2 ** (64 * (b - radius) / b) / 50)  # noqa: E731  a row costs about 50 comparisons
    return min(range(radius + 1, 2 * radius + 3), key=work)


#: Buckets of at most so many lie end to end in shared planes; rows that a task takes at once.
_SMALL, _AT_ONCE = 64, 1 << 16


def links(points: DataFrame, radius: int = 4, chunk: int = 2048, blocks: int | None = None, files: int | None = None) -> DataFrame:
    """Spanning links (u, v) between the nodes of distinct fingerprints (fp, node) within the radius."""
    blocks = blocks or blocks_for(points.count(), radius)
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        parts = [F.shiftrightunsigned("fp", edges[x]).bitwiseAND(F.lit((1 << (edges[x + 1] - edges[x])) - 1)) for x in chosen]
        keys.append(F.xxhash64(F.lit(t), *parts))
    dealt = points.select("fp", "node", F.explode(F.array(*keys)).alias("bucket"))
    size = shared.cut(dealt.groupBy("bucket").count().where("count > 1").withColumn("chunks", F.ceil(F.col("count") / chunk).cast("int")).select("bucket", "chunks"), files)
    dealt = dealt.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiles = dealt.select("bucket", "own", "fp", "node", other.alias("other"))
    tiles = tiles.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp", "node")
    tiles = tiles.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    names = ("bucket", "a", "b", "side", "fp", "node")

    def done(work: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.ones(len(work["fp"]) + 1, bool)
        new[1:-1] = np.logical_or.reduce([work[k][1:] != work[k][:-1] for k in ("bucket", "a", "b")])
        first = np.flatnonzero(new)
        length = np.diff(first)
        fp = work["fp"].view(np.uint64)
        small = (length <= _SMALL) & (work["a"][first[:-1]] == work["b"][first[:-1]])
        group = np.repeat(np.arange(len(length)), length)
        rows = np.flatnonzero(small[group])
        u, v = ([x] for x in _small_links(fp[rows], work["node"][rows], group[rows], length[group[rows]], radius))
        for g in np.flatnonzero(~small & (length > 1)):
            s, e = first[g], first[g + 1]
            got = _bucket_links(fp[s:e], work["node"][s:e], work["side"][s:e] * (work["a"][s] != work["b"][s]), radius)
            u.append(got[0])
            v.append(got[1])
        u, v = star(np.concatenate(u), np.concatenate(v))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append({k: batch.column(k).to_numpy() for k in names})
            size += batch.num_rows
            if size >= _AT_ONCE:
                work = {k: np.concatenate([x[k] for x in held]) for k in names}
                same = np.logical_and.reduce([work[k] == work[k][-1] for k in ("bucket", "a", "b")])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
                if cut:
                    yield done({k: x[:cut] for k, x in work.items()})
                held, size = [{k: x[cut:] for k, x in work.items()}], size - cut
        if size:
            yield done({k: np.concatenate([x[k] for x in held]) for k in names})

    return tiles.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, chunk: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    rows = shared.cut(fingerprints(docs))
    points = shared.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(points.select("fp", F.col("fp").alias("node")), radius, chunk))
    named = shared.cut(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = shared.cut(named.join(ids, "component").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
