"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow boosted trees over statistics of labelled texts give conjunctive rules, one for each path
from a root to a node. A logistic model with a lasso penalty picks and weighs few of them, and the
result is compiled into one Spark column expression, so that scoring runs in the JVM.

Defined cases: a null text counts as the empty text and is scored as such. Repeated rows and equal
doc_ids are each scored by themselves, ties alike. A long text's words are held whole, in the JVM. Without labelled rows every score is 0.5. Labels with a null
doc_id or value, or with several values for a doc_id, teach nothing. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample

WORD = "[^\\x20\\x09-\\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as column expressions, none of which grows with a table."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.char_length(t), F.lit(1))
    return {
        "_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        "_lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0),
        "log_chars": F.log1p(F.char_length(t).cast("double")),
        "symbols": F.regexp_count(t, F.lit("[#*$%&<>=_~^]")) / chars,
        "pipes": F.regexp_count(t, F.lit("[|]")) / chars,
        "exclaims": F.regexp_count(t, F.lit("[!?]")) / chars,
        "upper": F.regexp_count(t, F.lit("[A-Z]")) / chars,
        "digits": F.regexp_count(t, F.lit("[0-9]")) / chars,
        "stops": F.regexp_count(t, F.lit("[.,;:]")) / chars,
    }


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents with their statistics, and the names of these."""
    base = statistics(F.col("text"))
    docs = docs.select("*", *(c.alias(f"stat_{k}") for k, c in base.items()))
    n_words = F.greatest(F.size("stat__words"), F.lit(1))
    n_lines = F.greatest(F.size("stat__lines"), F.lit(1))
    chars = F.expm1("stat_log_chars")
    more = {
        "log_words": F.log1p(F.size("stat__words").cast("double")),
        "distinct_words": F.size(F.array_distinct("stat__words")) / n_words,
        "word_length": chars / n_words,
        "distinct_lines": F.size(F.array_distinct("stat__lines")) / n_lines,
        "line_words": F.log1p(n_words / n_lines),
    }
    names = [f"stat_{k}" for k in base if not k.startswith("_")] + [f"stat_{k}" for k in more]
    return docs.select("*", *(c.cast("double").alias(f"stat_{k}") for k, c in more.items())).drop("stat__words", "stat__lines"), names


def _tree(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, value: np.ndarray) -> None:
    """One regression tree on gradients; each node's path becomes a rule, each leaf's step goes to value."""
    if path:
        rules.add(path)
    best = (1e-3, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    if depth and len(rows) >= 20:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            place = np.searchsorted(c, x[rows, j], "left")
            gl = np.cumsum(np.bincount(place, grad[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(place, hess[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(place, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < 5) | (len(rows) - n < 5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, float(c[k])))
    if best[1] is None:
        value[rows] = g / (h + 1)
        return
    j, c = best[1]
    left = x[rows, j] <= c
    _tree(x, cuts, grad, hess, rows[left], depth - 1, (*path, (j, "<=", c)), rules, value)
    _tree(x, cuts, grad, hess, rows[~left], depth - 1, (*path, (j, ">", c)), rules, value)


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> list[tuple]:
    """Rules of boosted trees, each fitted on a different half of the rows."""
    rng = np.random.default_rng(11)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 40))) for j in range(x.shape[1])]
    cuts = [np.unique(np.float64([f"{v:.6g}" for v in c])) for c in cuts]
    f, rules = np.zeros(len(x)), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(x), max(1, len(x) // 2), replace=False))
        value = np.zeros(len(x))
        _tree(x, cuts, y - p, p * (1 - p), rows, depth, (), rules, value)
        f[rows] += rate * value[rows]
    return sorted(rules)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([x[:, j] <= c if op == "<=" else x[:, j] > c for j, op, c in rule])


def fit_lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with a lasso penalty by accelerated proximal gradients; the intercept is free."""
    n, k = r.shape
    mean, sd = r.mean(0), r.std(0) + 1e-9
    z = (r - mean) / sd
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, vb, t = w.copy(), b, 1.0
    rate = 4 * n / (np.linalg.norm(z.T @ z, 2) + n)
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30))) - y
        new = v - rate * (z.T @ e) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = vb - rate * e.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb, w, b, t = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b), new, nb, nt
    return w / sd, b - float((w / sd) @ mean)


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.003) -> tuple[list[tuple], np.ndarray, float]:
    """The rules with a weight, their weights, and the intercept."""
    rules = extract_rules(x, y)
    if not rules or y.min() == y.max():
        return [], np.zeros(0), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    r = np.stack([holds(k, x) for k in rules], 1).astype(float)
    _, first = np.unique(r, axis=1, return_index=True)
    first = np.array([j for j in np.sort(first) if 0 < r[:, j].mean() < 1], int)
    w, b = fit_lasso(r[:, first], y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return [rules[first[k]] for k in keep], w[keep], b


def compile_rules(names: list[str], rules: list[tuple], weights: np.ndarray, bias: float) -> Column:
    """The probability of the ensemble as one column expression."""
    total = F.lit(float(bias))
    for rule, w in zip(rules, weights, strict=True):
        test = F.lit(True)
        for j, op, c in rule:
            test = test & (F.col(names[j]) <= c if op == "<=" else F.col(names[j]) > c)
        total = total + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def label_sample(labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """doc_id and one label of a bounded sample of the labelled rows where learn holds."""
    good = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    good = good.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").select("doc_id", "label")
    return bounded_sample(good, "doc_id", "label", most)


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 5000) -> DataFrame:
    """doc_id and score of each document, the probability that labels.quality is 1.

    Fitted on about ``most`` labelled documents of each class among those where ``learn``, a
    condition on doc_id, holds. The sample of ids has at most 2 * most rows of two numbers, which
    bounds what is broadcast and, as statistics, sent to the driver.
    """
    sample = label_sample(labels, "quality", learn, most)
    known, names = with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    rows = known.select("label", *names).toArrow()
    y = np.array(rows.column("label").to_pylist(), float)
    x = np.stack([rows.column(k).to_numpy() for k in names], 1) if len(y) else np.zeros((0, len(names)))
    rules, weights, bias = fit_rules(x, y) if len(y) else ([], np.zeros(0), 0.0)
    used = {j for rule in rules for j, _, _ in rule}
    scored, names = with_statistics(docs.select("doc_id", "text"))
    return scored.select("doc_id", compile_rules(names, rules, weights, bias).alias("score"), F.lit(len(rules)).alias("n_rules"), F.lit(len(used)).alias("n_statistics"))
