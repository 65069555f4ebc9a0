"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. The cells' token counts are raked until the
token shares of every source, language and topic meet their targets; a document's inclusion
probability is its cell's raked weight, scaled to a token budget and capped at one, and a hash of
its id decides whether it is sampled.

Defined cases: null source, lang or text count as categories '' and as a text without words. An empty
text has no tokens; it follows its cell, and a cell without any token keeps all of its documents.
Equal doc_ids are drawn alike, ties and repeated rows with them; null doc_ids are drawn as the empty id. Categories
with no target take their observed share, tempered. Long texts are counted whole, in the JVM. An empty table gives
no rows. Other columns are not read unless they are to be kept; they may have any name.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DIMENSIONS = ("source", "lang", "topic")
#: Exponent on the observed shares where no explicit targets are given: 1 keeps, 0 levels them.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}


def topic_of(text: Column) -> Column:
    """A coarse topic by form: tabular, markup, shouting, or prose by length."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1))
    return (
        F.when(F.regexp_count(t, F.lit("[|]")) / n > 0.02, "table")
        .when(F.regexp_count(t, F.lit("[#*$%&<>]")) / n > 0.05, "markup")
        .when(F.regexp_count(t, F.lit("!")) / n > 0.05, "shout")
        .when(n < 1000, "short prose")
        .when(n < 5000, "prose")
        .otherwise("long prose")
    )


def target_shares(values: np.ndarray, tokens: np.ndarray, target: dict[str, float] | float) -> dict[str, float]:
    """Shares by category that sum to one: given ones, or observed ones to a power."""
    names, at = np.unique(values.astype(str), return_inverse=True)
    share = np.bincount(at, tokens) / max(tokens.sum(), 1)
    power = target if isinstance(target, (int, float)) else 0.7
    goal = np.where(share > 0, share, 1e-300) ** power * (share > 0)
    if isinstance(target, dict):
        goal = np.array([target.get(n, g) if s > 0 else 0.0 for n, g, s in zip(names, goal, share, strict=True)])
    return dict(zip(names, goal / max(goal.sum(), 1e-300), strict=True))


def rake(cells: dict[str, np.ndarray], tokens: np.ndarray, targets: dict[str, dict[str, float]], steps: int = 2000, close: float = 1e-10) -> tuple[np.ndarray, float]:
    """Token shares of the cells whose marginals meet the targets, as near to the observed ones as can be; and by how much a marginal misses.

    Targets that contradict each other, as where a source is in one language alone, are not met; the last
    marginals, which are between them, come with a warning.
    """
    share = tokens / max(tokens.sum(), 1)
    coded = []
    for k, goal in targets.items():
        names, at = np.unique(cells[k].astype(str), return_inverse=True)
        coded.append((at, np.array([goal.get(n, 0.0) for n in names])))
    worst = 0.0
    for _ in range(steps):
        worst = 0.0
        for at, goal in coded:
            now = np.bincount(at, share, len(goal))
            worst = max(worst, float(np.abs(now - goal).max(initial=0)))
            share = share * np.where(now > 0, goal / np.maximum(now, 1e-300), 0)[at]
        if worst < close:
            break
    if worst > 1e-4:
        warnings.warn(f"the targets can't all be met: after {steps} steps a share is {worst:.2g} from its target", stacklevel=2)
    return share, worst


def probabilities(share: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Inclusion probabilities in proportion to share / tokens, at most one, that expect budget tokens in all."""
    ratio = np.where(tokens > 0, share / np.maximum(tokens, 1), 0)
    if budget >= tokens[ratio > 0].sum():
        return np.where((tokens > 0) & (ratio == 0), 0.0, 1.0)
    low, high = 0.0, 1.0
    while (np.minimum(1, high * ratio) * tokens).sum() < budget * (1 - 1e-12) and high < 1e30:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * tokens).sum() < budget else (low, mid)
    return np.where(tokens > 0, np.minimum(1, high * ratio), 1.0)


def mix_documents(docs: DataFrame, targets: dict[str, dict[str, float] | float] | None = None, keep: float = 0.5, seed: str = "mix", most_cells: int = 500_000, keep_columns: tuple[str, ...] = (), topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and sampled of each row.

    ``topic`` is any expression over the input, such as a column of labels; without one a topic is the form
    of a text, by :func:`topic_of`.

    With ``keep_columns`` the rows have these columns of the input, weight, probability and sampled;
    cells are then told again from the texts, which saves moving these.

    ``targets`` has for each dimension explicit shares or an exponent; ``keep`` is the share of all
    tokens to draw. Cells are few beside documents: up to ``most_cells`` of them are raked on the
    driver, and more than that is an error, to be met by coarser sources.
    """
    spark = docs.sparkSession
    goals = TEMPER | (targets or {})
    cell = {"source": F.coalesce("source", F.lit("")), "lang": F.coalesce("lang", F.lit("")), "topic": F.coalesce(topic.cast("string"), F.lit("")) if topic is not None else topic_of(F.col("text"))}
    n_tokens = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", *(c.alias(k) for k, c in cell.items()), n_tokens.alias("n_tokens"))
    rows = rows if keep_columns else shared.cut(rows)
    found = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).limit(most_cells + 1).toPandas()
    if len(found) > most_cells:
        raise ValueError(f"more than {most_cells} cells of source, language and topic; map the sources to coarser ones first")
    found = found.sort_values(list(DIMENSIONS), ignore_index=True)
    tokens = found["tokens"].to_numpy(float)
    share, _ = rake({k: found[k].to_numpy() for k in DIMENSIONS}, tokens, {k: target_shares(found[k].to_numpy(), tokens, goals[k]) for k in DIMENSIONS})
    found["weight"] = np.where(tokens > 0, share * tokens.sum() / np.maximum(tokens, 1), 1.0)
    found["probability"] = probabilities(share, tokens, keep * tokens.sum())
    cells = spark.createDataFrame(found[[*DIMENSIONS, "weight", "probability"]], "source string, lang string, topic string, weight double, probability double")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    if keep_columns:
        own = docs.select(*keep_columns, *(c.alias(f"cell_{k}") for k, c in cell.items()))
        cells = cells.select(*(F.col(k).alias(f"cell_{k}") for k in DIMENSIONS), "weight", "probability")
        return own.join(F.broadcast(cells), [f"cell_{k}" for k in DIMENSIONS]).select(*keep_columns, "weight", "probability", (draw < F.col("probability")).alias("sampled"))
    return rows.join(F.broadcast(cells), list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", (draw < F.col("probability")).alias("sampled"))
