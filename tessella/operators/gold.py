"""Alignment of records with gold ones and across runs, and their comparison field by field.

Records meet in groups, by paragraph and what tells statements of a paragraph apart. Records of one group with equal
tokens are a class, and classes that share a token are scored by a join; the rest scores nothing and is paired in order. A task then
walks down the scores of its sorted groups, with the positions of each class as a queue, so that equal records
cost their number and not its square.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import storage
from tessella.functions import predicates
from tessella.functions import text as X

#: Fields whose difference is hard or soft, by class.
HARD = {"DEFINITIONAL": ("term", "definition", "source_article"), "APPLICABILITY": ("scope_type", "applies_to", "polarity", "source_article"), "DEONTIC": ("modality", "source_article")}
SOFT = {"DEFINITIONAL": ("applies_to_healthcare",), "APPLICABILITY": ("condition", "applies_to_healthcare"), "DEONTIC": ("subject", "predicate", "object", "condition", "beneficiary", "applies_to_healthcare", "severity")}


def discriminator(rows: DataFrame) -> Column:
    """What tells the statements of a paragraph apart."""
    part = lambda *c: F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in c))
    c = F.col("statement_class")
    return F.when(c == "DEFINITIONAL", F.concat(F.lit("DEF|"), predicates.text_udf("term"))).when(c == "APPLICABILITY", F.concat(F.lit("APP|"), part("scope_type", "polarity"))).when(c == "DEONTIC", F.concat(F.lit("DEO|"), part("modality"))).when(c == "NOT_APPLICABLE", "NA").otherwise(c)


def _classes(side: DataFrame, key: list[str], name: str) -> DataFrame:
    """key, c (the sorted tokens; one null where there are none) and at, the positions in order, of each class of equal records."""
    tokens = F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))))
    tokens = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(None).cast("string")))
    return side.select(*key, "position", tokens.alias("c")).groupBy(*key, "c").agg(F.array_sort(F.collect_list("position")).alias("at")).withColumn("side", F.lit(name))


class _Walk:
    """The greedy assignment of one group: queues of positions by class, and the class pairs of the score at hand."""

    def __init__(self) -> None:
        self.queues: dict[tuple[str, Any], list[int]] = {}
        self.score: float | None = None
        self.level: dict[Any, list[Any]] = {}

    def take(self) -> Iterator[tuple[int, int, float]]:
        """Assigns what the class pairs of one score allow: left positions in order, each to the first right one that is free."""
        heads = [(q[-1], c) for c in self.level if (q := self.queues["l", c])]
        heapq.heapify(heads)
        while heads:
            at, c = heads[0]
            free = [q for d in self.level[c] if (q := self.queues["r", d])]
            if not free:
                heapq.heappop(heads)
                continue
            mine = self.queues["l", c]
            mine.pop()
            yield at, min(free, key=lambda q: q[-1]).pop(), self.score
            if mine:
                heapq.heapreplace(heads, (mine[-1], c))
            else:
                heapq.heappop(heads)
        self.level = {}

    def row(self, side: str | None, c: int, d: int | None, at: list[int] | None, score: float | None) -> Iterator[tuple[int, int, float]]:
        if side is not None:
            self.queues[side, c] = at[::-1]
            return
        if score != self.score:
            yield from self.take()
            self.score = score
        self.level.setdefault(c, []).append(d)


def _streamed(rows: DataFrame, key: list[str], order: list[Column | str], used: list[str], begin: Any, out: list[T.StructField]) -> DataFrame:
    """Rows sorted in their groups pass a state each, which yields rows as it goes and at the end (``take``)."""
    schema = T.StructType([*(rows.schema[k] for k in key), *out])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kinds = None, None, None
        for batch in batches:
            kinds = kinds or [batch.schema.field(k).type for k in key]
            found: list[tuple] = []
            for group, row in zip(zip(*(batch.column(k).to_pylist() for k in key), strict=True), zip(*(batch.column(c).to_pylist() for c in used), strict=True), strict=True):
                if state is None or group != at:
                    if state is not None:
                        found += [(*at, *r) for r in state.take()]
                    at, state = group, begin()
                found += [(*at, *r) for r in state.row(*row)]
            if found:
                yield pack(found, kinds)
        if state is not None and (found := [(*at, *r) for r in state.take()]):
            yield pack(found, kinds)

    def pack(found: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        types = [*kinds, *({"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[f.dataType.simpleString()] for f in out)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def matches(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """key, l, r and score: what a walk down the Jaccard scores of all pairs of a group takes, each end once; ties by the left and then the right position.

    left and right: key, position and tokens. Pairs that share no token score 0, come last and are taken in order, so they are
    zipped and not made.
    """
    a, b = _classes(left, key, "l"), _classes(right, key, "r")
    number = lambda c: F.xxhash64(c)  # noqa: E731  a class of one group by the hash of its tokens
    queues = a.union(b).select(*key, "side", number("c").alias("c"), F.lit(None).cast("long").alias("d"), F.transform("at", lambda x: x.cast("long")).alias("at"), F.lit(None).cast("double").alias("score"))
    word = lambda rows, c: rows.select(*key, number("c").alias(c), F.size("c").alias(f"n_{c}"), F.explode(F.transform("c", lambda w: F.coalesce(F.concat(F.lit("w"), w), F.lit("")))).alias("w"))
    met = word(a, "c").join(word(b, "d"), [*key, "w"]).groupBy(*key, "c", "d").agg(F.count("*").alias("both"), F.first("n_c").alias("n_c"), F.first("n_d").alias("n_d"))
    score = F.col("both") / (F.col("n_c") + F.col("n_d") - F.col("both"))
    scored = met.select(*key, F.lit(None).cast("string").alias("side"), "c", "d", F.lit(None).cast("array<bigint>").alias("at"), score.alias("score"))
    ends = [T.StructField("l", T.LongType()), T.StructField("r", T.LongType()), T.StructField("score", T.DoubleType())]
    found = storage.cut(_streamed(queues.unionByName(scored), key, [F.col("side").isNull(), F.desc("score")], ["side", "c", "d", "at", "score"], _Walk, ends))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("at")).alias("rank")
    rest = [rows.select(*key, F.col("position").cast("long").alias("at")).join(found.select(*key, F.col(end).alias("at")), [*key, "at"], "left_anti").select(*key, F.col("at").alias(end), rank) for rows, end in ((left, "l"), (right, "r"))]
    return found.unionByName(rest[0].join(rest[1], [*key, "rank"]).select(*key, "l", "r", F.lit(0.0).alias("score")))


def align(gold: DataFrame, run: DataFrame, key: list[str]) -> DataFrame:
    """key, kind (pair, missing or extra), l, r and score: the greedy assignment of each group, and what is left on either side."""
    found = storage.cut(matches(gold, run, key))
    pairs = found.select(*key, F.lit("pair").alias("kind"), "l", "r", F.round("score", 6).alias("score"))
    rest = lambda side, end, other, kind: side.select(*key, F.col("position").alias(end)).join(found.select(*key, end), [*key, end], "left_anti").select(*key, F.lit(kind).alias("kind"), *((F.col(c) if c == end else F.lit(None).cast(side.schema["position"].dataType)).alias(c) for c in ("l", "r")), F.lit(None).cast("double").alias("score"))
    return pairs.unionByName(rest(gold, "l", "r", "missing")).unionByName(rest(run, "r", "l", "extra"))


#: A target that so many references name is looked up by itself, so that they don't meet in one task.
OFTEN = 100_000


def translated(references: DataFrame, ids: DataFrame) -> DataFrame:
    """References (id, at, target) of a run with the gold ids (run_id, gold_id) of the statements that they name; others stay.

    Of targets named often there are at most the references by ``OFTEN``; they go to every task, and their references are dealt by themselves.
    """
    ids = ids.select(F.col("run_id").alias("target"), "gold_id")
    often = storage.cut(references.groupBy("target").count().where(F.col("count") >= OFTEN).select("target"))
    known = storage.cut(ids.join(F.broadcast(often), "target"))
    hot = often.join(known, "target", "left").select("target", F.col("gold_id").alias("_known"), F.lit(True).alias("_often"))
    out = references.join(F.broadcast(hot), "target", "left")
    apart = F.when(F.col("_often") | F.col("target").isNull(), F.concat(F.lit("\0"), F.xxhash64("id", "at").cast("string"))).otherwise(F.col("target"))
    out = out.withColumn("_apart", apart).join(ids.select(F.col("target").alias("_apart"), "gold_id"), "_apart", "left")
    return out.select("id", "at", F.coalesce("_known", "gold_id", "target").alias("target"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two citations are equal, or one is above the other."""
    return (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def references_match(gold: Column, run: Column) -> Column:
    """Whether each gold citation, in order, takes a compatible one of the run that is still free, and all of these are taken."""
    none = F.array().cast("array<string>")
    g, r = F.coalesce(gold, none), F.coalesce(run, none)
    state = F.struct(r.alias("free"), F.lit(True).alias("good"))

    def take(s: Column, x: Column) -> Column:
        fits = F.transform(s["free"], lambda c: compatible(x, c))
        at = F.array_position(fits, F.lit(True)).cast("int")
        rest = F.filter(s["free"], lambda c, i: i + 1 != at)
        return F.struct(F.when(at > 0, rest).otherwise(s["free"]).alias("free"), (s["good"] & (at > 0)).alias("good"))

    end = F.aggregate(g, state, take)
    return (F.size(g) == F.size(r)) & end["good"]


def canonical(rows: DataFrame) -> DataFrame:
    """The fields of records in the form in which they are compared: normal texts, lists as 'value(method)', predicates without scaffolding.

    Each different text is brought to normal form once a batch; list slots are arrays of struct(value, method), others are such structs.
    """
    listed = lambda c, value: F.transform(F.col(c), lambda e: F.struct(value(e).alias("value"), e["method"].alias("method")))
    verb = lambda e: predicates.normalised(e["value"], F.col("modality"))["text"]
    out = rows
    for c in ("subject", "predicate", "object"):
        if c in rows.columns:
            parts = listed(c, verb if c == "predicate" else (lambda e: e["value"]))
            out = out.withColumn(c, F.transform(parts, lambda e: F.concat(X.plain_form(e["value"]), F.lit("("), F.coalesce(e["method"], F.lit("")), F.lit(")"))))
    for c in ("condition", "beneficiary", "definition", "applies_to"):
        if c in rows.columns:
            out = out.withColumn(c, predicates.text_udf(F.col(c)["value"]))
    for c in ("term",):
        if c in rows.columns:
            out = out.withColumn(c, predicates.text_udf(c))
    return out


def compare(pairs: DataFrame, gold: DataFrame, run: DataFrame, references_hard: bool = False) -> DataFrame:
    """gold_id, run_id, class, hard and soft (names of fields that differ) and bucket of matched records.

    gold and run: statement_id, statement_class, the fields and needs_review, canonical; pairs: gold_id and run_id. A difference of
    class stops the comparison. References are compared as sets of compatible citations, those to statements by the
    gold statement that theirs is matched with. needs_review counts where the gold record has it.
    """
    none = F.array().cast("array<string>")
    n = storage.parts(pairs.sparkSession, gold.count() + run.count())
    pairs = pairs.repartition(n, "run_id")
    refs = run.select(F.col("statement_id").alias("id"), F.posexplode(F.coalesce("references", none)).alias("at", "target"))
    moved = translated(refs, pairs).repartition(n, "id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "target"))), lambda x: x["target"]).alias("r_references"))
    g = gold.select(*(F.col(c).alias(f"g_{c}") for c in gold.columns))
    g = g.repartition(n, "g_statement_id")
    r = run.drop("references").select(*(F.col(c).alias(f"r_{c}") for c in run.columns if c != "references")).repartition(n, "r_statement_id")
    met = pairs.join(g, F.col("gold_id") == F.col("g_statement_id")).repartition(n, "run_id").join(r, F.col("run_id") == F.col("r_statement_id")).join(moved, F.col("run_id") == F.col("id"), "left")
    differs = lambda c: ~F.col(f"g_{c}").eqNullSafe(F.col(f"r_{c}"))
    names = set(gold.columns) & set(run.columns)

    def told(fields: dict[str, tuple[str, ...]]) -> list[Column]:
        return [F.when((F.col("g_statement_class") == k) & differs(c), c) for k, cs in fields.items() for c in cs if c in names]

    reference = F.when((F.col("g_statement_class") != "NOT_APPLICABLE") & ~references_match(F.col("g_references"), F.col("r_references")), "references")
    review = F.when(F.col("g_needs_review").isNotNull() & differs("needs_review"), "needs_review") if "needs_review" in names else F.lit(None).cast("string")
    other = differs("statement_class")
    hard = F.when(other, F.array(F.lit("statement_class"))).otherwise(F.array_compact(F.array(*told(HARD), *([reference] if references_hard else []), review)))
    soft = F.when(other, none).otherwise(F.array_compact(F.array(*told(SOFT), *([] if references_hard else [reference]), F.lit(None).cast("string"))))
    out = met.select("gold_id", "run_id", F.col("g_statement_class").alias("class"), F.array_sort(hard).alias("hard"), F.array_sort(soft).alias("soft"))
    return out.withColumn("bucket", F.when(F.size("hard") > 0, "hard").otherwise("clean"))


def scored_gold(gold: DataFrame) -> DataFrame:
    """The gold records that count: not those that depend on the screening."""
    return gold.where(~F.coalesce("screen_dependent", F.lit(False)))


class _Slots:
    """The slots of one group: the token sets of their members, and the runs that these come from."""

    def __init__(self) -> None:
        self.slots: list[tuple[list[frozenset], set]] = []

    def row(self, run: Any, position: int, tokens: list[str] | None) -> Iterator[tuple]:
        own, best, most = frozenset(tokens or ()), len(self.slots), -1.0
        for k, (members, runs) in enumerate(self.slots):
            if run not in runs:
                like = sum(len(own & m) / len(own | m) if own or m else 1.0 for m in members) / len(members)
                if like > most:
                    best, most = k, like
        if best == len(self.slots):
            self.slots.append(([], set()))
        self.slots[best][0].append(own)
        self.slots[best][1].add(run)
        yield run, position, best

    def take(self) -> Iterator[tuple]:
        return iter(())


def cluster_runs(records: DataFrame, key: list[str]) -> DataFrame:
    """key, run, position and slot: in run order each record joins the slot without that run whose members are most like it, else it opens one.

    Records of one run take part in the order of their positions, and a slot of equal likeness is the first one. One pass
    over sorted rows places them all; a task holds the token sets of one group.
    """
    rows = records.select(*key, "run", "position", F.array_distinct("tokens").alias("tokens"))
    out = [T.StructField("run", rows.schema["run"].dataType), T.StructField("position", rows.schema["position"].dataType), T.StructField("slot", T.LongType())]
    return _streamed(rows, key, ["run", "position"], ["run", "position", "tokens"], _Slots, out)
