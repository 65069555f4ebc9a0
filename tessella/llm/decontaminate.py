"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some tokens of a window and ignore the others, so that a hash of the picked ones still
meets after substitutions at ignored places. Hashes of the benchmark's windows are joined with
those of all training windows; around each hit, on its diagonal, the overlap that tolerates
substitutions is verified token by token.

The masks miss no overlap of 13 tokens or more at 0.8 or more; with other values, masks have to be given. Where a text
and an item share so many seeds that these outnumber the diagonals, as where both repeat a word, all diagonals
are verified instead of each hit.

The benchmark is handled in slices by hash, about ``slice_bytes`` each: a slice's index goes to all tasks, which
read the documents once for it; a larger benchmark takes more slices, not more memory. Only an item that is larger
itself makes a larger slice.

Defined cases: null and empty texts on either side have no tokens and meet nothing. Items shorter than
the least overlap are met as a whole, by masks of the item's own length that miss no substitutions; items of fewer
than ``least_item`` tokens, which common phrases would meet, are not looked for. Repeated rows of documents are reported
once each; repeated rows of an item count as one, and different texts under one id are each looked for and reported.
Of equally long overlaps the one found first, on the lowest diagonal, is reported. A long text is read whole, at
about 100 bytes of a task's memory a byte. Empty tables give no rows. Other columns are not read; they may have any
name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as tc
from .toxicity import folded, tokens

#: Spaced seeds; 1 takes a token, 0 ignores it. Each overlap of 13 tokens or more with a similarity
#: of 0.8 or more meets one of these somewhere, as test_masks_miss_nothing proves by enumeration; found by greedy cover.
MASKS = ("111011011", "111000010111", "11110111", "110110001101", "1101010111", "1110101000011", "1111111")
#: A slice of the benchmark has about so many bytes of text at most; shorter items, in tokens, are not looked for.
SLICE_BYTES, LEAST_ITEM = 8 << 20, 4


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and their bounds."""
    buf, offsets = tc.text_parts(column)
    starts, ends, bounds = tokens(buf, offsets)
    return tc.span_hashes(tc.prefix_hashes(folded(buf)), starts, ends), bounds


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the picked tokens of the window at each token."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
    return tc.mix(out)


def whole_masks(n: int, similarity: float) -> list[str]:
    """Masks of a whole item of n tokens, one of which meets whatever the substitutions: two clean parts of two more than these."""
    ratio = Fraction(similarity).limit_denominator(1000)
    most = n * (ratio.denominator - ratio.numerator) // ratio.denominator
    if most == 0:
        return ["1" * n]
    take = 2 if most + 2 <= n else 1
    parts = np.arange(n) * min(most + take, n) // n
    return ["".join("01"[p in pair] for p in parts.tolist()) for pair in itertools.combinations(range(min(most + take, n)), take)]


class Index:
    """Seed hashes of a slice of the benchmark, with the item and place of each."""

    def __init__(self, items: pa.Array, masks: tuple[str, ...] = MASKS, least: int = 13, similarity: float = 0.8, least_item: int = 1):
        self.h, self.bounds = token_hashes(items)
        doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        shortest = max(least, min(map(len, masks)))
        lengths = np.diff(self.bounds)
        short = np.unique(lengths[(lengths >= max(1, least_item)) & (lengths < shortest)]).tolist()
        self.masks = (*masks, *itertools.chain.from_iterable(whole_masks(n, similarity) for n in short))
        self.seeds = []
        for k, mask in enumerate(self.masks):
            s = seed_hashes(self.h, mask)
            at = np.flatnonzero(doc[: len(s)] == doc[len(mask) - 1 :]) if len(s) else np.zeros(0, int)
            at = at[lengths[doc[at]] == len(mask)] if k >= len(masks) else at[lengths[doc[at]] >= least_item]
            at = at[np.argsort(s[at], kind="stable")]
            seen = np.zeros(1 << 22, bool)
            seen[s[at] >> np.uint64(42)] = True
            self.seeds.append((s[at], at, doc[at], seen))

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal), the diagonal being the place in the text less that in the item."""
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        met, pairs, times = [], [], []
        for mask, (keys, _, items, seen) in zip(self.masks, self.seeds, strict=True):
            s = seed_hashes(h, mask)
            at = np.flatnonzero(seen[s >> np.uint64(42)])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            # the places of one seed in one text stand for each other
            order = np.lexsort((s[at], doc[at]))
            at = at[order]
            new = np.ones(len(at), bool)
            new[1:] = (s[at[1:]] != s[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
            one = np.flatnonzero(new)
            size = np.diff(np.append(one, len(at)))
            first, last = np.searchsorted(keys, s[at[one]], "left"), np.searchsorted(keys, s[at[one]], "right")
            n = last - first
            k = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append(np.repeat(doc[at[one]], n) * len(self.bounds) + items[k])
            times.append(np.repeat(size, n))
            met.append((at, np.repeat(one, n), np.repeat(size, n), k))
        if not pairs:
            return np.zeros((0, 3), np.int64)
        pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
        text, item = pair // len(self.bounds), pair % len(self.bounds)
        diagonals = np.diff(bounds)[text] + np.diff(self.bounds)[item] - 1
        many = np.bincount(back, np.concatenate(times), len(pair)) > diagonals
        at = np.flatnonzero(many)
        low = -np.diff(self.bounds)[item[at]] + 1  # a diagonal for each offset of the two
        own = np.repeat(at, diagonals[at])
        found = [np.stack([text[own], item[own], np.repeat(low - (np.cumsum(diagonals[at]) - diagonals[at]), diagonals[at]) + np.arange(len(own))], 1)]
        edge = 0
        for (at, one, size, k), (_, places, items, _) in zip(met, self.seeds, strict=True):
            few = np.flatnonzero(~many[back[edge : edge + len(k)]])
            edge += len(k)
            one, size, k = one[few], size[few], k[few]
            place = at[np.repeat(one - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            k = np.repeat(k, size)
            found.append(np.stack([doc[place], items[k], (place - bounds[doc[place]]) - (places[k] - self.bounds[items[k]])], 1))
        return np.unique(np.concatenate(found), axis=0)


def best_run(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """Ends of the run with the largest sum when a match counts 1 - similarity and a substitution -similarity."""
    score = _sums(same, similarity)
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
    return start, end


def longest_run(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """Ends of the longest run from a match to a match that has the similarity, the first of equal ones; (0, 0) if nothing matches."""
    score, at = _sums(same, similarity), np.flatnonzero(same)
    if not len(at):
        return 0, 0
    low = np.minimum.accumulate(score[at])  # the least sum before one of the first matches
    first = np.searchsorted(-low, -score[at + 1], "left")
    k = int(np.argmax(at + 1 - at[first]))
    return int(at[first[k]]), int(at[k]) + 1


def _sums(same: np.ndarray, similarity: float) -> np.ndarray:
    """Cumulated whole numbers that are at least zero over a run where its share of matches is at least the similarity."""
    ratio = Fraction(similarity).limit_denominator(1000)
    return np.concatenate([[0], np.cumsum(np.where(same, ratio.denominator - ratio.numerator, -ratio.numerator))])


def overlap_run(same: np.ndarray, least: int, similarity: float, whole: bool) -> tuple[int, int]:
    """Ends of the overlap to report of a diagonal, (0, 0) if it has none; ``whole`` says that the diagonal covers its item."""
    start, end = best_run(same, similarity)
    if end - start >= least or (whole and end - start == len(same)):
        return start, end
    start, end = longest_run(same, similarity)
    if end - start >= least:
        return start, end
    return (0, len(same)) if whole and _sums(same, similarity)[-1] >= 0 else (0, 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, similarity: float = 0.8, masks: tuple[str, ...] = MASKS, slice_bytes: int = SLICE_BYTES, least_item: int = LEAST_ITEM) -> DataFrame:
    """One row for each document and item with an overlap of at least ``least`` tokens, or the whole item, at the similarity.

    An overlap begins and ends with a match, unless it is the whole item. doc_id, item_id, doc_token,
    item_token (where it begins), n_tokens, n_substituted and similarity of the longest overlap, each
    diagonal having one: its run that gains most from matches over substitutions, if that is long
    enough, and otherwise its longest run.
    """
    spark = docs.sparkSession
    tc.tune(spark)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), *(T.StructField(k, T.LongType()) for k in ("doc_token", "item_token", "n_tokens", "n_substituted")), T.StructField("similarity", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    for part in _slices(benchmark, slice_bytes):
        out = out.union(docs.select("doc_id", "text").mapInArrow(_search(part, Index(part.column("text").combine_chunks(), masks, least, similarity, least_item), least, similarity, schema), schema))
    return out


def _slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[pa.Table]:
    """The different items in parts of about so many bytes; each takes a pass over the documents."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // slice_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        if part.num_rows:
            yield part.sort_by([("item_id", "ascending"), ("text", "ascending")])


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 13, similarity: float = 0.8, masks: tuple[str, ...] = MASKS, slice_bytes: int = SLICE_BYTES, least_item: int = LEAST_ITEM) -> DataFrame:
    """The documents that no item overlaps so, in a chain of passes without a shuffle, one for each slice of the benchmark."""
    tc.tune(docs.sparkSession)
    for part in _slices(benchmark, slice_bytes):
        docs = docs.mapInArrow(_filter(Index(part.column("text").combine_chunks(), masks, least, similarity, least_item), least, similarity), docs.schema)
    return docs


def _filter(index: Index, least: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            bad = {d for d, _ in overlaps(index, batch.column("text"), least, similarity)}
            yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)]))

    return run


def overlaps(index: Index, column: pa.Array, least: int, similarity: float) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """Of each text and item that overlap: where in the text and the item, tokens and substitutions of the longest overlap."""
    h, bounds = token_hashes(column)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for d, i, diagonal in index.hits(h, bounds).tolist():
        a, b = h[bounds[d] : bounds[d + 1]], index.h[index.bounds[i] : index.bounds[i + 1]]
        lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
        same = a[lo + diagonal : hi + diagonal] == b[lo:hi]
        s, e = overlap_run(same, least, similarity, hi - lo == len(b))
        n, bad = e - s, int((~same[s:e]).sum())
        if n > best.get((d, i), (0, 0, 0))[2]:
            best[d, i] = (lo + s + diagonal, lo + s, n, bad)
    return best


def _search(part: pa.Table, index: Index, least: int, similarity: float, schema: T.StructType):
    ids = part.column("item_id").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            best = overlaps(index, batch.column("text"), least, similarity)
            if best:
                doc, item = batch.column("doc_id").to_pylist(), ids
                rows = [(doc[d], item[i], *v, 1 - v[3] / v[2]) for (d, i), v in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), _arrow(schema), strict=True)], names=schema.fieldNames())

    return run


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]
