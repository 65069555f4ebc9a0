"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures, confirmed on whole sets.

A signature has 16 bits of each of K least hashes of a set of word shingles, K = m * s in m chunks of s. By pigeonhole two
signatures that differ in at most 2 m - 1 places have a chunk with at most one error; each chunk is therefore entered once
for each place that may be wrong, under the other s - 1 values: all pairs within that distance share an entry, and none
needs a scan. Nothing that shares an entry is cut off by its distance; sizes, parities and then the whole sets
decide (see near_copies). s grows with the number of rows, so that chance entries stay few; m is the least for which a pair at the
similarity itself has no common entry with a chance of ``missed`` (1e-9), and more similar ones far less.

Every class of equal sets is compared with the hub of each of its entries, the two most promising first; then classes that share a hub
but are in different components are compared by sizes and parities where they are held, first the closest of each two components, then all. Links so found join all
that a comparison of all pairs would; pairs inside a component are not listed.

Defined cases: words are split at ASCII white space and compared in ASCII lower case. A text of fewer words than a shingle
has one, all of it; null, empty and blank texts have none, are linked with nothing and kept. Repeated rows are one class.
Rows with a null doc_id are compared too; their component is the smallest doc_id reachable, or null, and they are not kept
unless there is none. A long text is read whole, at about 60 bytes of a task's memory a byte. An empty table gives no rows.
Other columns are not read. The input must be a table or a checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import beside, near_copies, shared
from . import textcols as tc
from .components import components

_U = np.uint64


def layout(n: int, least: float, missed: float = 1e-9) -> tuple[int, int]:
    """Chunks of a signature, and places of a chunk, for n rows."""
    size = 4 + max(0, math.ceil(math.log(max(n, 1) / 2**20, 2**4)))
    shared_entry = least**size + size * least ** (size - 1) * (1 - least)  # a chunk with one error at most
    return (math.ceil(math.log(missed) / math.log(1 - shared_entry)) if shared_entry < 1 else 1), size


def signatures(h: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """16 bits of each least hash of each set of hashes; zero for empty sets."""
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), places), np.uint16)
    if len(full):
        seeds = tc.mix(np.arange(1, 2 * places + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        x = np.empty_like(h)
        for k in range(places):
            np.bitwise_xor(h, seeds[2 * k], out=x)
            x *= seeds[2 * k + 1] | _U(1)
            out[full, k] = (tc.mix(np.minimum.reduceat(x, bounds[full])) >> _U(48)).astype(np.uint16)
    return out


def entries(signature: np.ndarray, chunks: int, size: int) -> np.ndarray:
    """The entries of each signature: for each chunk and place left out, a hash of the rest."""
    parts = signature.reshape(len(signature), chunks, size).astype(np.uint64)
    out = np.empty((len(signature), chunks, size), np.uint64)
    for w in range(size):
        x = np.broadcast_to(np.arange(chunks, dtype=np.uint64) * _U(size) + _U(w), parts.shape[:2]).copy()
        for j in range(size):
            if j != w:
                x = tc.mix(x * _U(0x9E3779B97F4A7C15) + parts[:, :, j] + _U(1))
        out[:, :, w] = x
    return out.reshape(len(signature), -1)


def _rows(docs: DataFrame, width: int, places: int) -> DataFrame:
    """doc_id, _scan_row, node (a hash of the set), n, bits (its parities) and sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            h, bounds, node = near_copies.read_sets(batch.column("text"), width)
            sig = signatures(h, bounds, places)
            columns = [batch.column("doc_id"), batch.column("_scan_row"), pa.array(node), pa.array(np.diff(bounds)), pa.array(near_copies.parities(h, bounds), pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_scan_row", "node", "n", "bits", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_scan_row", "text").mapInArrow(run, f"doc_id {kind}, _scan_row long, node long, n long, bits binary, sig binary")


def hubs(signed: DataFrame, chunks: int, size: int) -> DataFrame:
    """hub and node, once each, of all that share an entry; the hub is the smallest node of the entry and its own too. signed: node and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                keys = entries(sig, chunks, size)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), keys.shape[1]))], names=["key", "node"])

    entered = signed.select("node", "sig").mapInArrow(run, "key long, node long")
    several = entered.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    return shared.cut(entered.join(several, "key").select("hub", "node").distinct())


def links(rows: DataFrame, docs: DataFrame, chunks: int, size: int, width: int, least: float, chunk: int = near_copies.CHUNK) -> DataFrame:
    """Links (u, v) that join all classes of non-empty sets whose similarity is at least ``least``; not all pairs."""
    classes = shared.cut(rows.where("n > 0").groupBy("node").agg(F.min("_scan_row").alias("_scan_row"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sig").alias("sig")))
    family = hubs(classes, chunks, size)
    stars = near_copies.possible(family.where("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v")), classes, least)
    best = stars.groupBy("v").agg(F.slice(F.array_sort(F.collect_list(F.struct("differ", "u"))), 1, 2).alias("best"))  # of at most one hub an entry
    first = shared.cut(best.select(F.explode("best.u").alias("u"), "v"))
    found = near_copies.alike(first, classes, docs, width, least)
    tried = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    for few in (4, None):  # links among the closest pairs of two components first, so that few components are left for all pairs
        named = shared.cut(family.join(components(found), "node", "left").select("hub", "node", F.coalesce("root", "node").alias("c")))
        rest = shared.cut(near_copies.across(named, classes, least, chunk, few).join(tried, ["u", "v"], "left_anti"))
        found, tried = found.union(near_copies.alike(rest, classes, docs, width, least)), tried.union(rest)
    return found


def near_duplicates(docs: DataFrame, width: int = 2, least: float = 0.8, missed: float = 1e-9) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept of each row."""
    tc.tune(docs.sparkSession)
    docs = beside.numbered(docs.select("doc_id", "text"), "_scan_row")
    chunks, size = layout(docs.count(), least, missed)
    rows = shared.cut(_rows(docs, width, chunks * size))
    roots = components(links(rows, docs, chunks, size, width, least))
    group = F.coalesce("root", "node").alias("component")
    named = shared.cut(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("id")).join(roots, "node", "left").select("node", "id", group))
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of = shared.cut(named.join(ids, "component").select("node", "component_id"))
    out = rows.select("doc_id", "node", "n").join(of, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
