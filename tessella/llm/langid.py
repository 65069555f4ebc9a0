"""Language identification by hierarchical discrimination.

A linear model over hashed byte n-grams predicts the language family first; within the family,
one-versus-one linear support vector machines separate the closely related languages and vote.
All models of a text are one lookup: a table from n-gram bucket to the weights of every model,
summed over the whole text in one pass.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Repeated rows are each
predicted by themselves; null doc_ids are kept; ties of votes go to the first language by name; a long text is read
whole, at about 100 bytes of a task's memory a byte; an empty table gives no rows. With no labelled
row at all every text is ``und``. Other columns are not read; they may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as tc
from .sampling import bounded_sample

#: Families of languages by ISO 639-1 code. Any other language is a family by itself.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
BITS = 14
ORDERS = (2, 3, 4)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, f"only:{lang}")


def buckets(buf: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the byte n-gram that starts at each byte, letters in lower case."""
    low = tc.LOWER[buf].astype(np.uint32)
    m = len(low) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    out = low[:m].copy()
    for j in range(1, n):
        out = (out << np.uint32(8)) | low[j : j + m]
    return (out * np.uint32(2654435761) + np.uint32(n * 0x61C88647 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)


def profile_sums(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean over each text's n-grams of the table's rows, for all models at once."""
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    for n in ORDERS:
        b = buckets(buf, n)
        last = np.maximum(offsets[1:] - (n - 1), offsets[:-1])
        last, first = np.minimum(last, len(b)), np.minimum(offsets[:-1], len(b))
        for k in range(table.shape[1]):
            total = np.zeros(len(b) + 1)
            np.cumsum(table[:, k][b], out=total[1:], dtype=np.float64)
            out[:, k] += (total[last] - total[first]) / np.maximum(last - first, 1)
    return out


class Profiles:
    """Bucket frequencies of texts, sparse: those of text i are at bounds[i] to bounds[i + 1]."""

    def __init__(self, bounds: np.ndarray, bucket: np.ndarray, value: np.ndarray):
        self.bounds, self.bucket, self.value = bounds, bucket, value

    @classmethod
    def of(cls, column: pa.Array) -> Profiles:
        buf, offsets = tc.text_parts(column)
        found = []
        for d in range(len(column)):
            total = np.zeros(1 << BITS)
            for n in ORDERS:
                part = buckets(buf[offsets[d] : offsets[d + 1]], n)
                if len(part):
                    total += np.bincount(part, minlength=1 << BITS) / len(part)
            at = np.flatnonzero(total)
            found.append((at.astype(np.uint16), total[at].astype(np.float32)))
        empty = (np.zeros(0, np.uint16), np.zeros(0, np.float32))
        return cls(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int64), *(np.concatenate([empty[k], *(x[k] for x in found)]) for k in (0, 1)))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 1 << BITS), np.float32)
        for k, i in enumerate(rows):
            part = slice(self.bounds[i], self.bounds[i + 1])
            out[k, self.bucket[part]] = self.value[part]
        return out

    def dot(self, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.value * weight[self.bucket], dtype=np.float64)])
        return total[self.bounds[rows + 1]] - total[self.bounds[rows]]


def fit_svm(x: Profiles, use: np.ndarray, sign: np.ndarray, epochs: int = 5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine on the texts in ``use`` by averaged stochastic subgradients, classes weighted alike."""
    rng = np.random.default_rng(7)
    weight, bias, mean_w, mean_b, t = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), 0.0, 0
    balance = {s: len(sign) / (2 * max(1, int((sign == s).sum()))) for s in (-1, 1)}
    size = 32
    for _ in range(epochs):
        order = rng.permutation(len(use))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            t += 1
            rate = 1 / (decay * (t + 200))
            part = x.dense(use[rows])
            margin = sign[rows] * (part @ weight + bias)
            g = np.where(margin < 1, sign[rows] * np.array([balance[s] for s in sign[rows]]), 0) / len(rows)
            weight = (1 - rate * decay) * weight + rate * (g @ part)
            bias += 0.1 * g.sum()
            mean_w += (weight - mean_w) / t
            mean_b += (bias - mean_b) / t
    return mean_w, mean_b


def platt(margin: np.ndarray, sign: np.ndarray) -> float:
    """Slope of a logistic link from margins to probabilities."""
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin * sign, -30, 30)))
        grad, curve = ((1 - p) * margin * sign).mean() - 1e-3 * slope, (p * (1 - p) * margin**2).mean() + 1e-3
        slope = float(np.clip(slope + grad / curve, 0.1, 50))
    return slope


class LanguageModel:
    """Families by one-versus-rest, then languages by one-versus-one within each family."""

    def __init__(self, x: Profiles, langs: list[str]):
        langs = np.array(langs, dtype=object)
        # frequencies on a root scale are what the models see at scoring too, through the table
        self.scale = 1 / (np.sqrt(np.bincount(x.bucket, x.value, 1 << BITS) / len(x)) + 1e-4)
        value = x.value * self.scale[x.bucket]
        norm = float(np.sqrt(np.dot(value, value) / len(x))) or 1.0
        x = Profiles(x.bounds, x.bucket, (value / norm).astype(np.float32))
        families = np.array([family_of(v) for v in langs], dtype=object)
        self.families = sorted(set(families))
        self.langs = {f: sorted(set(langs[families == f])) for f in self.families}
        self.columns, self.bias, self.slope = [], [], []

        def add(rows: np.ndarray, sign: np.ndarray) -> int:
            w, b = fit_svm(x, rows, sign)
            self.slope.append(platt(x.dot(w, rows) + b, sign))
            self.columns.append((w * self.scale / norm).astype(np.float32))
            self.bias.append(b)
            return len(self.columns) - 1

        everyone = np.arange(len(langs))
        self.of_family = {f: add(everyone, np.where(families == f, 1, -1)) for f in self.families[1 if len(self.families) == 2 else 0 :]} if len(self.families) > 1 else {}
        self.of_pair = {}
        for f, members in self.langs.items():
            for a, b in itertools.combinations(members, 2):
                rows = np.flatnonzero((langs == a) | (langs == b))
                self.of_pair[a, b] = add(rows, np.where(langs[rows] == a, 1, -1))
        self.table = np.stack(self.columns, 1) if self.columns else np.zeros((1 << BITS, 0), np.float32)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, offsets = tc.text_parts(column)
        p = profile_sums(buf, offsets, self.table) + np.array(self.bias)
        p = 1 / (1 + np.exp(-np.clip(p * np.array(self.slope), -30, 30)))
        n = len(column)
        by_family = np.stack([p[:, self.of_family[f]] if f in self.of_family else np.ones(n) for f in self.families], 1)
        if len(self.families) == 2:
            by_family[:, 0] = 1 - by_family[:, 1]
        by_family /= np.maximum(by_family.sum(1, keepdims=True), 1e-12)
        family = by_family.argmax(1)
        lang, score = np.empty(n, object), by_family.max(1)
        for k, f in enumerate(self.families):
            rows, members = np.flatnonzero(family == k), self.langs[f]
            votes = np.zeros((len(rows), len(members)))
            for i, j in itertools.combinations(range(len(members)), 2):
                q = p[rows, self.of_pair[members[i], members[j]]]
                votes[:, i] += (q >= 0.5) + q * 1e-3
                votes[:, j] += (q < 0.5) + (1 - q) * 1e-3
            best = votes.argmax(1)
            lang[rows] = np.array(members, dtype=object)[best]
            for i, j in itertools.combinations(range(len(members)), 2):  # the closest rival decides how sure it is
                q = p[rows, self.of_pair[members[i], members[j]]]
                q = np.where(best == i, q, np.where(best == j, 1 - q, 1.0))
                score[rows] = np.minimum(score[rows], by_family.max(1)[rows] * q)
        return lang, np.clip(score, 0.0, 1.0)


def identify_languages(docs: DataFrame, learn: Column, per_language: int = 400, most_texts: int = 8000) -> DataFrame:
    """doc_id, lang_pred and score of each text.

    The models are fitted on ``per_language`` texts of each language, and ``most_texts`` in all, among the rows
    where ``learn`` holds and lang is not null: a bounded sample by hash of doc_id. Their n-gram counts,
    at most 100 KB a text and 20 KB for a usual one, are what the driver gets.
    """
    spark = docs.sparkSession
    tc.tune(spark)
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            x = Profiles.of(batch.column("text"))
            parts = [slice(a, b) for a, b in zip(x.bounds[:-1], x.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([x.bucket[p].tobytes() for p in parts], pa.binary()), pa.array([x.value[p].tobytes() for p in parts], pa.binary())], names=["lang", "bucket", "value"])

    got = bounded_sample(labelled, "doc_id", "lang", per_language, most_texts).select("lang", "text").mapInArrow(counted, "lang string, bucket binary, value binary").toArrow()
    rows = sorted(zip(*(got.column(k).to_pylist() for k in ("lang", "bucket", "value")), strict=True))  # the same whichever task ended first
    sizes = np.cumsum([0, *(len(x[1]) // 2 for x in rows)]).astype(np.int64)
    x = Profiles(sizes, np.frombuffer(b"".join(x[1] for x in rows), np.uint16), np.frombuffer(b"".join(x[2] for x in rows), np.float32))
    model = LanguageModel(x, [x[0] for x in rows]) if rows else None
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.sub_batches(batches):
            n, some = batch.num_rows, batch.column("letters").fill_null(False).to_numpy(zero_copy_only=False)
            lang, score = model.predict(batch.column("text")) if model else (np.full(n, "und", object), np.zeros(n))
            lang[~some], score[~some] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=schema.fieldNames())

    return docs.select("doc_id", "text", F.col("text").rlike("\\p{L}").alias("letters")).mapInArrow(run, schema)
