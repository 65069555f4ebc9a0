"""Removal of repeated substrings by merging Burrows-Wheeler transforms of shards.

A window is the ``width`` bytes from a place in a text; its anchor is the first place in it whose ``gram`` bytes
have the smallest hash. Windows in a row with one anchor form a segment, filed under the anchor's hash. Equal
windows have equal anchors at equal distances, so that segments under different hashes need not meet, and under
one hash only places at the same distance from the anchor: the strings of a task are laid over each other by
their anchors, and their transforms have one layer for each column of this layout.

The strings of a task form shards. A shard's transform has, for each column, the symbols that stand before
its suffixes in their order, and where each suffix goes when that symbol is put in front. The transforms are
merged by iterative interleave refinement (Holt and McMillan): starting with the shards one after another, each
step sorts stably by the preceding symbol and follows the LF-mapping, so that after k steps the suffixes of
all shards are in the order of their first k symbols. Common prefixes of neighbours follow from those of the
step before as the minimum over the range between them, plus one where the symbols agree. Rows between which
the common prefix never falls under ``width`` are a repeated interval; no suffix is sorted twice, nor
anything but the preceding symbols. Equal segments are one row with their number, as in a run-length
transform, and count as often.

A group under one hash is bounded: one with more than ``most_segments`` different segments, such as a passage in
very many texts, is split by quarters of the distances between window and anchor, and filed under a hash of the
bytes that all windows of such a quarter share, again and again while it is too large. In the end a group is a
single window. Nothing is dropped, and every group's repeats come from merged transforms.

Texts are read in place and never shuffled: what tasks learn about a text goes to a stored table by
scan partition, from which the task that scans this partition reads it.

Defined cases: null and empty texts have no bytes; texts shorter than the width keep all of theirs. Long
texts are cut into segments in pieces of a few MB that overlap by a window, so that a task's memory follows the
longest text only with its bytes and marks, about 30 times its size. Rows that repeat are separate texts, so
each loses what it shares with the other. Equal and null doc_ids are kept apart. An empty table gives no rows.
The input must be a table or a checkpoint, whose scan deals rows to partitions alike each time. Other columns
are not read; they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import beside, shared
from . import textcols as tc

WIDTH, GRAM, MOST_SEGMENTS = 200, 32, 1024
#: Segments that are merged at once; shards of these; bytes of text that are cut into segments at once.
CHUNK, SHARDS, PIECE = 8192, 4, 1 << 20
#: Segments and fetched segments, with their bytes, of a file, about.
SEGMENTS, FETCHED = 50_000, 5_000
_PAD = 255
_ROW = "_scan_row"


def segments(buf: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, start, windows, anchor's distance from the start, anchor's hash, content hash and repeats in a row of each segment."""
    none = np.zeros(0, np.int64)
    n = len(buf) - width + 1
    if n <= 0:
        return (none,) * 7
    own, size, span = tc.rolling_hashes(buf, gram), 1, width - gram + 1
    # the place in the low bits makes the first of equal hashes the smallest
    low = (own & ~np.uint64(0xFFFFFF)) | np.arange(len(own), dtype=np.uint64)
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: size - span], low[span - size :])
    low = (low & np.uint64(0xFFFFFF)).astype(np.int32)
    long = np.diff(offsets) >= width
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, offsets[:-1][long], 1)
    np.add.at(step, offsets[1:][long] - width + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (low[1:] == low[:-1]))
    first[offsets[:-1][long]] = True
    start = np.flatnonzero(first)
    windows = np.flatnonzero(valid)
    length = np.diff(np.append(np.searchsorted(windows, start), len(windows)))
    anchor = low[start].astype(np.int64)
    text = np.searchsorted(offsets, start, "right") - 1
    content = tc.span_hashes(tc.prefix_hashes(buf), start, start + length + width - 1).view(np.int64)
    # equal segments on end, as of a periodic text, are one row
    new = np.ones(len(start), bool)
    new[1:] = (content[1:] != content[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + length[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(start)))
    return text[at], start[at] - offsets[text[at]], length[at], (anchor - start)[at], own[anchor[at]].view(np.int64), content[at], runs


def quarters(buf: np.ndarray, begin: np.ndarray, n: np.ndarray, anchor: np.ndarray, size: int, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments cut at distances from the anchor that are multiples of ``size``: owner, first window, windows, anchor, hash of the bytes all windows at these distances share, content hash."""
    most = width - gram
    lo, hi = (anchor - n + 1) // size, anchor // size
    owner = np.repeat(np.arange(len(n)), hi - lo + 1)
    part = np.repeat(lo, hi - lo + 1) + np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
    near, far = part * size, np.minimum(part * size + size - 1, most)  # distances of the last and the first window
    place = begin[owner] + anchor[owner]
    skip = anchor[owner] - np.minimum(far, anchor[owner])
    windows = anchor[owner] - np.maximum(near, (anchor - n + 1)[owner]) - skip + 1
    prefix, start = tc.prefix_hashes(buf), begin[owner] + skip
    core = tc.span_hashes(prefix, place - near, place - far + width)
    return owner, skip, windows, anchor[owner] - skip, core.view(np.int64), tc.span_hashes(prefix, start, start + windows + width - 1).view(np.int64)


class Shard:
    """Burrows-Wheeler transform of strings laid over each other: layers[t] has the strings' symbols at one column, from the right."""

    def __init__(self, layers: np.ndarray):
        steps, n = layers.shape
        self.bwt, self.lf = np.empty((steps, n), np.uint8), np.empty((steps, n), np.int32)
        order, place = np.arange(n), np.arange(n, dtype=np.int32)
        for t in range(steps):
            self.bwt[t] = symbol = layers[t][order]
            turn = np.argsort(symbol, kind="stable")
            self.lf[t][turn] = place
            order = order[turn]


def _lowest(values: np.ndarray, left: np.ndarray, right: np.ndarray, log: np.ndarray) -> np.ndarray:
    """The minimum of values[left + 1 : right + 1] for each pair."""
    k = log[right - left]
    table = [values]
    for j in range(int(k.max(initial=0))):
        x = table[-1].copy()
        np.minimum(x[: -(1 << j)], x[1 << j :], out=x[: -(1 << j)])
        table.append(x)
    flat, n = np.concatenate(table), len(values)
    return np.minimum(flat[k * n + left + 1], flat[k * n + right + 1 - (1 << k)])


def repeated_windows(data: np.ndarray, bounds: np.ndarray, n: np.ndarray, anchor: np.ndarray, copies: np.ndarray, width: int = WIDTH, gram: int = GRAM, shards: int = SHARDS) -> np.ndarray:
    """strings x windows: which windows occur twice or more in strings that occur ``copies`` times.

    String j is data[bounds[j] : bounds[j + 1]], of n[j] windows, its anchor at anchor[j]. Windows that are not at
    one distance from their anchors are taken to differ.
    """
    size, most = len(n), width - gram
    steps, kind = width + most, np.min_scalar_type(width)
    length = np.diff(bounds)
    layers = np.full((steps, size), _PAD, np.uint8)
    place = np.arange(bounds[-1] - bounds[0])
    place -= np.repeat(bounds[:-1] - bounds[0] + anchor + width - 1, length)  # from the layer of the anchor's window, to the left
    place *= -size
    place += np.repeat(np.arange(size), length)
    layers.reshape(-1)[place] = data
    del place
    cuts = np.linspace(0, size, min(shards, size) + 1).astype(int)
    built = [Shard(layers[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    bwt = np.concatenate([s.bwt for s in built], 1)
    lf = np.concatenate([s.lf + np.int32(a) for s, a in zip(built, cuts[:-1], strict=True)], 1)
    log = np.zeros(size + 1, np.int64)
    for k in range(1, size.bit_length()):
        log[1 << k :] = k
    rows, who, common = np.arange(size), np.arange(size), np.zeros(size, kind)
    out = np.zeros((size, most + 1), bool)
    for t in range(steps):
        symbol = bwt[t][rows]
        turn = np.argsort(symbol, kind="stable")
        symbol, rows, who = symbol[turn], lf[t][rows[turn]], who[turn]
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        low, common = _lowest(common, turn[same], turn[same + 1], log), np.zeros(size, kind)
        common[same + 1] = np.minimum(low, width - 1) + 1
        if t >= width - 1:  # windows begin at this column
            at = anchor[who] + width - 1 - t
            real = (at >= 0) & (at < n[who])
            block = np.cumsum(common < width) - 1
            total = np.bincount(block, np.where(real, copies[who], 0))
            found = np.flatnonzero(real & (total[block] > 1))
            out[who[found], at[found]] = True
    return out


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of marks."""
    edge = np.diff(np.pad(mark, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


_SEGMENT = "r long, start long, n int, a int, m long, s long, w long"
_FETCHED = "m long, r long, start long, n int, a int, w long, s long, split boolean, bytes binary"
_MERGED = "r long, start long, end long, s long"


def _cut(docs: DataFrame, at: str, width: int, gram: int) -> DataFrame:
    """Stores all segments, those of equal content on end as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            r = batch.column("r").to_numpy()
            buf, offsets = tc.text_parts(batch.column("text"))
            for lo in range(0, max(1, len(buf) - width + 1), PIECE):  # more than one only for a single long text
                piece = buf[lo : lo + PIECE + width - 1]
                part = offsets if len(piece) == len(buf) else np.array([0, len(piece)])
                text, start, n, a, m, s, w = segments(piece, part, width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(r[text]), pa.array(start + lo), pa.array(n.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(m), pa.array(s), pa.array(w)], names=["r", "start", "n", "a", "m", "s", "w"])

    docs.mapInArrow(run, _SEGMENT).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def _strings(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of spans, which may overlap."""
    edges = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.arange(edges[-1]) + np.repeat(begin - edges[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def _fetch(docs: DataFrame, chosen: DataFrame, at: str, width: int) -> DataFrame:
    """Stores chosen segments (m, r, start, n, a, w, s, split) with their bytes, from the texts."""
    beside.store(chosen, f"{at}/chosen")
    names = ["m", "r", "start", "n", "a", "w", "s", "split"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = None
        for batch in tc.sub_batches(batches):
            r = batch.column("r").to_numpy()
            if not len(r):
                continue
            side = beside.stored(f"{at}/chosen", int(r[0])) if side is None else side
            rows, text = beside.rows_of(side, r)
            if not len(rows):
                continue
            buf, offsets = tc.text_parts(batch.column("text"))
            begin, size = offsets[text] + side["start"][rows], side["n"][rows].astype(np.int64) + width - 1
            first = buf[begin[0] : begin[0] + size[0]]
            if tc.span_hashes(tc.prefix_hashes(first), np.array([0]), np.array([len(first)])).view(np.int64)[0] != side["s"][rows[0]]:
                raise ValueError("the scan dealt rows otherwise than before; store the input as a table first")
            for lo in range(0, len(rows), 8192):
                part = slice(lo, lo + 8192)
                yield pa.RecordBatch.from_arrays([*(pa.array(side[k][rows[part]]) for k in names), _strings(buf, begin[part], size[part])], names=[*names, "bytes"])

    docs.mapInArrow(run, _FETCHED).write.parquet(f"{at}/fetched")
    shared.remove(docs.sparkSession, f"{at}/chosen")
    return docs.sparkSession.read.parquet(f"{at}/fetched")


def _split(fetched: DataFrame, at: str, size: int, width: int, gram: int) -> DataFrame:
    """Stores the quarters of the fetched segments that are to be split; up is the content hash of the whole one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches, "bytes"):
            if batch.num_rows:
                r, start, n, a, w, s = (batch.column(k).to_numpy() for k in ("r", "start", "n", "a", "w", "s"))
                buf, bounds = tc.text_parts(batch.column("bytes"))
                owner, skip, windows, anchor, m, own = quarters(buf, bounds[:-1], n.astype(np.int64), a.astype(np.int64), size, width, gram)
                arrays = [pa.array(x) for x in (r[owner], start[owner] + skip, windows.astype(np.int32), anchor.astype(np.int32), m, own, w[owner], s[owner])]
                yield pa.RecordBatch.from_arrays([*arrays, _strings(buf, bounds[:-1][owner] + skip, windows + width - 1)], names=["r", "start", "n", "a", "m", "s", "w", "up", "bytes"])

    fetched.where("split").mapInArrow(run, f"{_SEGMENT}, up long, bytes binary").write.parquet(f"{at}/quarters")
    return fetched.sparkSession.read.parquet(f"{at}/quarters")


def _merge(fetched: DataFrame, at: str, width: int, gram: int) -> DataFrame:
    """Stores repeated spans (r, start, end) of segments that occur once, and the content hash s of those that occur more often."""

    def done(table: pa.Table) -> pa.RecordBatch:
        r, start, n, a, w, s = (table.column(k).to_numpy() for k in ("r", "start", "n", "a", "w", "s"))
        data, bounds = tc.text_parts(table.column("bytes"))
        mark = repeated_windows(data, bounds, n, a, w, width, gram)
        often = w > 1
        whole = np.flatnonzero(often & mark.any(1))  # and then all of their windows
        row, first, last = _runs(mark & ~often[:, None])
        none = pa.nulls(len(whole), pa.int64())
        lists = [(pa.array(r[row]), none), (pa.array(start[row] + first), none), (pa.array(start[row] + last + width), none), (pa.nulls(len(row), pa.int64()), pa.array(s[whole]))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in lists], names=["r", "start", "end", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                table = pa.Table.from_batches(held)
                m = table.column("m").to_numpy()
                cut = int(np.searchsorted(m, m[-1]))  # the last group may go on
                if cut:
                    yield done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size -= cut
        if size:
            yield done(pa.Table.from_batches(held))
        tc.release()

    rows = fetched.where("not split").select("m", "r", "start", "n", "a", "w", "s", "bytes")
    rows.repartition("m").sortWithinPartitions("m").mapInArrow(run, _MERGED).coalesce(shared.files(fetched.count(), FETCHED)).write.parquet(f"{at}/merged")
    return fetched.sparkSession.read.parquet(f"{at}/merged")


def _solve(found: DataFrame, fetch: Callable[[DataFrame, str], DataFrame], at: str, size: int, width: int, gram: int, most_segments: int) -> tuple[DataFrame, DataFrame]:
    """Repeated spans (r, start, end) of the found segments, and the rows of ``found`` that repeat as a whole.

    found: the rows of _cut or _split, whose windows are less than ``size`` apart in their distances from the
    anchor. fetch(chosen, at) stores chosen ones with their bytes.
    """
    spark = found.sparkSession
    kinds = found.groupBy("m", "s").agg(F.sum("w").alias("w"), F.max("r").alias("r"), F.max_by("start", "r").alias("start"), F.first("n").alias("n"), F.first("a").alias("a"))
    files = shared.files(found.count(), SEGMENTS)
    kinds.coalesce(files).write.parquet(f"{at}/kinds")
    kinds = spark.read.parquet(f"{at}/kinds")
    kinds.groupBy("m").agg(F.count("*").alias("different"), F.sum("w").alias("all")).where("all > 1").select("m", (F.col("different") > most_segments).alias("split")).coalesce(files).write.parquet(f"{at}/groups")
    groups = spark.read.parquet(f"{at}/groups")
    fetched = fetch(kinds.join(groups, "m"), at)
    merged = _merge(fetched, at, width, gram)
    spans, repeat = merged.where("r is not null").drop("s"), merged.where("s is not null").select("s")
    if size > 1 and groups.where("split").limit(1).count():
        parted = _split(fetched, at, size // 4, width, gram)
        shared.remove(spark, f"{at}/fetched")

        def own(chosen: DataFrame, below: str) -> DataFrame:
            parted.drop("w", "n", "a").join(chosen, ["m", "s", "r", "start"]).coalesce(shared.files(parted.count(), SEGMENTS)).write.parquet(f"{below}/fetched")
            return spark.read.parquet(f"{below}/fetched")

        smaller, whole = _solve(parted, own, f"{at}/more", size // 4, width, gram, most_segments)
        spans, repeat = spans.union(smaller), repeat.union(whole.where("w > 1").select("up").distinct())
    shared.remove(spark, f"{at}/fetched")
    whole = found.join(repeat, "s")
    ends = F.col("start") + F.col("n") * (F.col("w") if "up" not in found.columns else F.lit(1)) + width - 1
    return spans.union(whole.select("r", "start", ends.alias("end"))), whole


def repeated_spans(docs: DataFrame, at: str, width: int = WIDTH, gram: int = GRAM, most_segments: int = MOST_SEGMENTS) -> None:
    """Stores below ``at``/spans the byte spans (r, start, end) of texts that are covered by repeated windows.

    docs has r, a monotonically increasing id, and text.
    """
    size = 4 ** -(-(width - gram).bit_length() // 2)
    spans, _ = _solve(_cut(docs, f"{at}/segments", width, gram), lambda chosen, below: _fetch(docs, chosen, below, width), f"{at}/first", size, width, gram, most_segments)
    beside.store(spans, f"{at}/spans")
    shared.remove(docs.sparkSession, f"{at}/segments", f"{at}/first")


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most_segments: int = MOST_SEGMENTS, keep: tuple[str, ...] = ("doc_id",), text: bool = False) -> DataFrame:
    """The columns in ``keep`` with n_bytes, n_removed, n_spans and kept_sha256, and the text that is left if wanted.

    What is left of a character of which bytes are removed is dropped from that text.
    """
    spark = docs.sparkSession
    tc.tune(spark)
    at = shared.fresh(spark, "repeats")
    names = [k for k in keep if k in docs.columns and k != "text"]
    base = docs.select(*(F.col(k).alias(f"keep{i}") for i, k in enumerate(names)), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias(_ROW))
    repeated_spans(base.select(F.col(_ROW).alias("r"), "text"), at, width, gram, most_segments)
    longs = ("n_bytes", "n_removed", "n_spans")
    schema = T.StructType([*(T.StructField(f"keep{i}", docs.schema[k].dataType) for i, k in enumerate(names)), *(T.StructField(k, T.LongType()) for k in longs), T.StructField("kept_sha256", T.StringType()), *([T.StructField("left", T.StringType())] if text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = None
        for batch in tc.sub_batches(batches):
            r = batch.column(_ROW).to_numpy()
            if not len(r):
                continue
            side = beside.stored(f"{at}/spans", int(r[0])) if side is None else side
            buf, offsets = tc.text_parts(batch.column("text"))
            rows, doc = beside.rows_of(side, r)
            step = np.zeros(len(buf) + 1, np.int32)
            if len(rows):
                np.add.at(step, offsets[doc] + side["start"][rows], 1)
                np.add.at(step, offsets[doc] + side["end"][rows], -1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            _, _, bounds = tc.spans(gone, offsets)
            n = tc.per_text(gone, offsets)
            kept = [buf[a:b].tobytes() if not g else buf[a:b][~gone[a:b]].tobytes() for a, b, g in zip(offsets[:-1], offsets[1:], n, strict=True)]
            arrays = [*(batch.column(f"keep{i}") for i in range(len(names))), pa.array(np.diff(offsets)), pa.array(n), pa.array(np.diff(bounds)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            arrays += [pa.array([x.decode(errors="ignore") for x in kept])] if text else []
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    out = base.select(_ROW, "text", *(f"keep{i}" for i in range(len(names)))).mapInArrow(run, schema)
    return out.select(*(F.col(f"keep{i}").alias(k) for i, k in enumerate(names)), *longs, "kept_sha256", *([F.col("left").alias("text")] if text else []))
