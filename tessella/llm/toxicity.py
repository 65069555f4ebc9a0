"""Toxicity by a linear-chain conditional random field.

Labels are those of documents. A two-state chain over the features of tokens (the word and prefixes of it) is trained
in numpy by gradient ascent: it starts from tokens labelled by distant supervision, toxic where their document is
and one of their features marks toxic documents, and goes on with what the labels say for certain: no token of a
clean document is toxic, and of a window of a toxic one around such features at least one is. The expected counts
under that condition come from the same forward-backward pass, as the one path it rules out is all clean. A token's
marginal is by forward-backward too; the marginals of a document give its score, and the runs of likely toxic tokens its
offending byte offsets. The chain over millions of tokens is an exact blockwise scan: products of
2 x 2 matrices in each block, then messages across blocks, then within all blocks at once.

Defined cases: a null text counts as the empty text, which has no spans and the score of a text
without toxic tokens. Repeated rows are each scored by themselves, ties alike. A long text is one chain, read whole, at
about 200 bytes of a task's memory a byte. Without labelled rows of both
classes every score is the rate of the known class, or 0 if there is none. Labels that are null or
contradict each other teach nothing. Other columns are not read unless they are to be kept; they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from . import textcols as tc
from .quality import fit_lasso, label_sample

PREFIXES = (4, 5, 6, 7)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BLOCK = 128


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of letters and digits."""
    return tc.spans(_LETTER[buf], offsets)


def folded(buf: np.ndarray) -> np.ndarray:
    """The bytes with ASCII and Latin-1 capitals in lower case; lengths stay."""
    low = tc.LOWER[buf]
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    return low


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the features of each token: the word and its prefixes; 0 where a token is too short."""
    prefix = tc.prefix_hashes(folded(buf))
    out = [tc.span_hashes(prefix, starts, ends)]
    for n in PREFIXES:
        h = tc.span_hashes(prefix, starts, np.minimum(starts + n, ends)) ^ np.uint64(0xABCD * n)
        out.append(np.where(ends - starts >= n, h, np.uint64(0)))
    return np.stack(out, 1)


class Lookup:
    """Index of each known hash, or the number of known hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, len(self.hashes))
        at = np.nonzero(self.seen[h >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.hashes, h[at]), max(len(self.hashes) - 1, 0))
        out[at] = np.where(self.hashes[k] == h[at], k, len(self.hashes)) if len(self.hashes) else 0
        return out


def marginals(ratio: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of many chains laid end to end.

    ratio: emission of toxic against clean; first: where a chain begins; trans: 2 x 2, row by state
    before. A chain's first token has uniform messages, by a transition matrix of rank one.
    """
    n = len(ratio)
    if n == 0:
        return np.zeros(0)
    last = np.append(first[1:], True)

    def scan(r: np.ndarray, reset: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Forward odds of toxic, emission included."""
        size = -(-n // BLOCK)
        r = np.append(r, np.ones(size * BLOCK - n)).reshape(size, BLOCK)
        reset = np.append(reset, np.ones(size * BLOCK - n, bool)).reshape(size, BLOCK)
        # odds after a step: r * (a01 + a11 x) / (a00 + a10 x), or r at a reset
        p, q, s, t = (np.ones(size), np.zeros(size), np.zeros(size), np.ones(size))  # x -> (p x + q) / (s x + t)
        for k in range(BLOCK):
            z, e = reset[:, k], r[:, k]
            a11, a01 = np.where(z, 0, a[1, 1]) * e, np.where(z, 1, a[0, 1]) * e
            a10, a00 = np.where(z, 0, a[1, 0]), np.where(z, 1, a[0, 0])
            p, q, s, t = a11 * p + a01 * s, a11 * q + a01 * t, a10 * p + a00 * s, a10 * q + a00 * t
            norm = 1 / (p + q + s + t)
            p, q, s, t = p * norm, q * norm, s * norm, t * norm
        x, start = 1.0, np.empty(size)
        for k in range(size):
            start[k] = x
            x = min(max((p[k] * x + q[k]) / max(s[k] * x + t[k], 1e-300), 1e-150), 1e150)
        out, x = np.empty((size, BLOCK)), start
        for k in range(BLOCK):
            x = np.where(reset[:, k], 1.0, (a[0, 1] + a[1, 1] * x) / (a[0, 0] + a[1, 0] * x)) * r[:, k]
            x = np.clip(x, 1e-150, 1e150)
            out[:, k] = x
        return out.reshape(-1)[:n]

    ahead = scan(ratio, first, trans)
    back = scan(ratio[::-1], last[::-1], trans.T)[::-1]
    odds = np.clip(ahead * back / ratio, 1e-300, 1e300)
    return odds / (1 + odds)


def fit_chain(ids: np.ndarray, gold: np.ndarray, used: np.ndarray, toxic: np.ndarray, size: int, epochs: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of features, bias and transition scores of a two-state chain.

    ids: windows x positions x features (size where none); gold: first states; used: real positions; toxic: windows
    with a toxic token at least. Gradient ascent on the conditional log-likelihood: the counts that the
    labels tell less expected counts. In the first half of the epochs ``gold`` tells them; then, of toxic windows, the
    expected counts on condition that not all tokens are clean.
    """
    w, bias, trans = np.zeros(size + 1), -2.0, np.zeros((2, 2))
    m, length = gold.shape
    moment, second = np.zeros(size + 6), np.zeros(size + 6)
    for epoch in range(1, epochs + 1):
        score = bias + w[ids].sum(2)
        e = np.exp(np.clip(np.stack([np.zeros_like(score), score], 2), -30, 30))
        a = np.exp(trans)
        alpha, beta = np.empty((m, length, 2)), np.ones((m, length, 2))
        norm = e[:, 0].sum(1, keepdims=True)
        alpha[:, 0], total = e[:, 0] / norm, np.log(norm[:, 0])
        for k in range(1, length):
            x = (alpha[:, k - 1] @ a) * e[:, k]
            norm = x.sum(1, keepdims=True)
            alpha[:, k] = np.where(used[:, k, None], x / norm, alpha[:, k - 1])
            total += np.where(used[:, k], np.log(norm[:, 0]), 0.0)
        clean = np.exp(np.minimum((used.sum(1) - 1) * trans[0, 0] - total, 0))  # probability of the path without toxic tokens
        freed = toxic & (epoch > epochs // 2)
        scale = 1 / np.maximum(1 - clean, 1e-6)
        pair, freed_pair = np.zeros((2, 2)), np.zeros((2, 2))
        for k in range(length - 2, -1, -1):
            right = e[:, k + 1] * beta[:, k + 1]
            x = right @ a.T
            both = alpha[:, k, :, None] * a * right[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            pair += both[used[:, k + 1]].sum(0)
            rows = freed & used[:, k + 1]
            freed_pair += (both[rows] * scale[rows, None, None]).sum(0)
            freed_pair[0, 0] -= (clean[rows] * scale[rows]).sum()
            beta[:, k] = np.where(used[:, k + 1, None], x / x.sum(1, keepdims=True), 1.0)
        p = alpha * beta
        p = p[:, :, 1] / p.sum(2)
        miss = np.where(used, np.where(freed[:, None], np.minimum(p * scale[:, None], 1), gold) - p, 0)
        g = np.bincount(ids.reshape(-1), np.repeat(miss.reshape(-1), ids.shape[2]), size + 1)
        told = freed_pair.clip(0)
        both = used[:, 1:] & ~freed[:, None]
        np.add.at(told, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        grad = np.concatenate([g - 0.05 * w, [miss.sum()], (told - pair - 0.5 * trans).reshape(-1)])
        grad[size] = 0
        moment = 0.9 * moment + 0.1 * grad
        second = 0.98 * second + 0.02 * grad**2
        step = 0.15 * (moment / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.98**epoch)) + 1e-8)
        w, bias, trans = w + step[: size + 1], bias + step[size + 1], trans + step[size + 2 :].reshape(2, 2)
    return w, bias, trans


class Tagger:
    """A fitted chain over known feature hashes; marks token spans and sums up documents."""

    def __init__(self, lookup: Lookup, weights: np.ndarray, bias: float, trans: np.ndarray):
        self.lookup, self.weights, self.bias, self.trans = lookup, weights, bias, trans

    def tag(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        buf, offsets = tc.text_parts(column)
        starts, ends, bounds = tokens(buf, offsets)
        score = np.full(len(starts), self.bias)
        if len(starts):
            f = features(buf, starts, ends)
            for k in range(f.shape[1]):
                score += self.weights[self.lookup(f[:, k])]
        first = np.zeros(len(starts), bool)
        first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        p = marginals(np.exp(np.clip(score, -30, 30)), first, np.exp(self.trans))
        return p, starts, ends, bounds

    def summary(self, column: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Of each document: expected toxic tokens, share, largest marginal; and its toxic spans as flat offsets."""
        p, starts, ends, bounds = self.tag(column)
        total = np.zeros(len(p) + 1)
        np.cumsum(p, out=total[1:])
        expected = total[bounds[1:]] - total[bounds[:-1]]
        n = np.diff(bounds)
        top = np.zeros(len(n))
        if len(p):
            full = n > 0
            top[full] = np.maximum.reduceat(p, bounds[:-1][full])
        x = np.stack([np.log1p(expected), np.log1p(100 * expected / np.maximum(n, 1)), top, np.minimum(expected, 3.0), np.log1p(n)], 1)
        toxic = np.flatnonzero(p > 0.5)
        doc = np.searchsorted(bounds, toxic, "right") - 1
        _, offsets = tc.text_parts(column)
        out: list[list[int]] = [[] for _ in n]
        before = -2
        for i, d in zip(toxic, doc, strict=True):
            s, e = int(starts[i] - offsets[d]), int(ends[i] - offsets[d])
            if out[d] and before == i - 1:
                out[d][-1] = e
            else:
                out[d] += [s, e]
            before = i
        return x, out


def fit_tagger(known: DataFrame, most_features: int = 4000, window: int = 32, windows_each: int = 2) -> Tagger:
    """Fits the chain on a bounded set of documents with text and label.

    Features that mark toxic documents are found by counting, and the ``most_features`` of largest lift are those of
    the chain. It learns from ``windows_each`` windows of each document, drawn by a hash of its text: around such
    features first, and of clean documents anywhere else.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            buf, offsets = tc.text_parts(batch.column("text"))
            starts, ends, bounds = tokens(buf, offsets)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            label = batch.column("label").to_numpy().astype(np.int64)
            f = features(buf, starts, ends)
            for k in range(f.shape[1]):
                _, at = np.unique(f[:, k] ^ tc.mix(doc.astype(np.uint64)), return_index=True)
                h, back = np.unique(f[at, k], return_inverse=True)
                toxic = np.bincount(back, label[doc[at]], len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(h)) - toxic)], names=["h", "toxic", "clean"])

    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    least = max(3, n1 // 400)
    lift = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    marks = known.mapInArrow(count, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    marks = marks.where((F.col("h") != 0) & (F.col("toxic") >= least)).withColumn("lift", lift)
    picked = marks.where("lift >= 2").orderBy(F.desc("lift"), "h").limit(most_features).toArrow()
    hashes = picked.column("h").to_numpy().view(np.uint64)
    lookup = Lookup(hashes)
    strong = np.zeros(len(hashes) + 1, bool)
    strong[lookup(hashes[picked.column("lift").to_numpy() >= 4])] = True
    strong[-1] = False
    size = len(hashes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            buf, offsets = tc.text_parts(batch.column("text"))
            starts, ends, bounds = tokens(buf, offsets)
            own = tc.span_hashes(tc.prefix_hashes(buf), offsets[:-1], offsets[1:]).tolist()
            f = features(buf, starts, ends)
            ids = np.stack([lookup(f[:, k]) for k in range(f.shape[1])], 1)
            label = batch.column("label").to_pylist()
            rows = []
            for d in range(batch.num_rows):
                lo, hi = int(bounds[d]), int(bounds[d + 1])
                if lo == hi:
                    continue
                rng, hit = np.random.default_rng(own[d]), np.flatnonzero((ids[lo:hi] < size).any(1)) + lo
                centres = list(rng.choice(hit, min(windows_each, len(hit)), replace=False)) if len(hit) else []
                centres += list(rng.integers(lo, hi, windows_each - len(centres))) if label[d] == 0 else []
                for c in centres:
                    a = max(lo, min(int(c) - window // 2, hi - window))
                    b = min(hi, a + window)
                    block = np.full((window, ids.shape[1]), size, np.int32)
                    block[: b - a] = ids[a:b]
                    state = np.zeros(window, np.int32)
                    state[: b - a] = strong[ids[a:b]].any(1) if label[d] == 1 else 0
                    rows.append((block.tobytes(), state.astype(np.int8).tobytes(), b - a, bool(label[d] == 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["ids", "gold", "n", "toxic"])

    got = known.mapInArrow(cut, "ids binary, gold binary, n long, toxic boolean").toArrow()
    if got.num_rows == 0 or size == 0:
        return Tagger(Lookup(np.zeros(0, np.uint64)), np.zeros(1), -10.0, np.zeros((2, 2)))
    order = np.argsort(np.array([x.as_py() for x in got.column("ids")], dtype=object), kind="stable")  # the same whichever task ended first
    ids = np.stack([np.frombuffer(x.as_py(), np.int32) for x in got.column("ids")]).reshape(got.num_rows, window, -1)[order]
    gold = np.stack([np.frombuffer(x.as_py(), np.int8) for x in got.column("gold")]).astype(np.int64)[order]
    used = (np.arange(window) < got.column("n").to_numpy()[:, None])[order]
    return Tagger(lookup, *fit_chain(ids, gold, used, got.column("toxic").to_numpy()[order], size))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", most: int = 3000, keep: tuple[str, ...] = ("doc_id",), most_features: int = 4000, windows_each: int = 2) -> DataFrame:
    """The columns in ``keep`` with score and spans (start and end byte offsets, flat) of each document.

    Fitted on about ``most`` labelled documents of each class among those where ``learn``, a
    condition on doc_id, holds: a sample of at most 2 * most ids is broadcast, and fixed numbers
    of windows and features and one summary of each sampled document reach the driver.
    """
    spark = docs.sparkSession
    tc.tune(spark)
    sample = label_sample(labels, label, learn, most)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("label").cast("long").alias("label"))
    known = shared.cut(known.where(F.col("text").isNotNull()))
    tagger = fit_tagger(known, most_features, windows_each=windows_each)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            x, _ = tagger.summary(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(x[:, k]) for k in range(5))], names=["label", *"abcde"])

    rows = known.mapInArrow(summed, "label long, a double, b double, c double, d double, e double").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = np.stack([rows.column(k).to_numpy() for k in "abcde"], 1) if len(y) else np.zeros((0, 5))
    if len(y) and y.min() < y.max():
        w, b = fit_lasso(x, y, 1e-4, 1500)
    else:
        w, b = np.zeros(5), 30.0 if len(y) and y.min() == 1 else -30.0
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            x, found = tagger.summary(batch.column("text"))
            score = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(score), pa.array(found, pa.list_(pa.int64()))], names=schema.fieldNames())

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
