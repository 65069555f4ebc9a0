"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes find the n-grams that occur twice or more in a text, and
the characters of the words inside them are measured against all word characters; likewise the
characters of repeated lines. A longer n-gram repeats only where its two shorter parts do, so each
length looks at what the length before has left.

Defined cases: a null text is the empty text, without words, and fails the base rule. Rows that
repeat, equal doc_ids and null doc_ids are each scored by themselves. An empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textcols as tc

#: Most of the word characters that may lie inside repeated n-grams, by n.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of the word characters that may lie in lines that repeat an earlier line.
LINE_COVERAGE = 0.20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _spread(mark: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the marked windows of n words."""
    step = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(mark)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(column: pa.Array, coverage: dict[int, float], line_coverage: float) -> dict[str, np.ndarray]:
    """The counts and the verdict of each text of a column."""
    buf, offsets = tc.text_parts(column)
    starts, ends, bounds = tc.words(buf, offsets)
    n_docs, n_words = len(offsets) - 1, np.diff(bounds)
    prefix = tc.prefix_hashes(buf)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    length = chars[ends] - chars[starts]
    word_chars = tc.per_text(length, bounds)
    doc = np.repeat(np.arange(n_docs), n_words)
    hashes = tc.span_hashes(prefix, starts, ends)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": tc.per_text(_SYMBOL[buf], offsets)}

    newline = np.flatnonzero(buf == 10)
    cut = np.sort(np.concatenate([newline, offsets[1:] - 0]), kind="stable")
    line_ends = cut
    line_starts = np.concatenate([[0], cut[:-1] + (np.searchsorted(newline, cut[:-1], "right") > np.searchsorted(newline, cut[:-1]))]) if len(cut) else cut
    line_starts = np.minimum(line_starts, line_ends)
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = last > first
    line_starts, line_ends, first, last = line_starts[full], line_ends[full], first[full], last[full]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    key = tc.mix(tc.span_hashes(prefix, line_starts, line_ends) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    total = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=total[1:])
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs)
    line_share = np.bincount(line_doc[again], weights=(total[last] - total[first])[again], minlength=n_docs) / np.maximum(word_chars, 1)

    bad = line_share > line_coverage
    salt = doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    alive = None
    for n in sorted({5, *coverage}):
        grams = tc.gram_hashes(hashes, n)
        m = len(grams)
        ok = doc[:m] == doc[n - 1 :] if m else np.zeros(0, bool)
        if alive is not None:  # both parts of n - 1 words repeat
            ok = ok & alive[:m] & alive[1 : m + 1]
        at = np.flatnonzero(ok)
        twice = np.zeros(m, bool)
        twice[at] = _repeated(grams[at] ^ salt[at])
        inside = _spread(twice, n, len(hashes)) if m else np.zeros(len(hashes), bool)
        if n == 5:
            out["n_repeat_words"] = tc.per_text(inside, bounds)
        share = tc.per_text(np.where(inside, length, 0), bounds) / np.maximum(word_chars, 1)
        if n in coverage:
            bad |= share > coverage[n]
        out[f"share_{n}"] = share
        alive = twice
    out["line_share"] = line_share
    out["base_failed"] = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def repetition_rules(docs: DataFrame, coverage: dict[int, float] = COVERAGE, line_coverage: float = LINE_COVERAGE) -> DataFrame:
    """doc_id, counts, shares of characters in repeated n-grams and lines, base_failed and kept of each document."""
    tc.tune(docs.sparkSession)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [f"share_{n}" for n in sorted({5, *coverage})] + ["line_share"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in longs), *(T.StructField(x, T.BooleanType()) for x in ("base_failed", "kept")), *(T.StructField(x, T.DoubleType()) for x in shares)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            got = measure(batch.column("text"), coverage, line_coverage)
            arrays = [batch.column("doc_id"), *(pa.array(got[x].astype(np.int64)) for x in longs), pa.array(got["base_failed"]), pa.array(got["kept"]), *(pa.array(got[x].astype(float)) for x in shares)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)
