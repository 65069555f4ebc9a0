"""Repair of conversation structure: a forward Viterbi over four grammar states for each conversation.

A repaired conversation is empty, or one optional system turn and pairs of user and assistant. Each row is kept
(cost 0), given another role (1) or deleted (2, the only way for blank rows and repeats); an empty user or assistant
turn can be inserted anywhere (5), and a truncated row that stays costs 5 more. After each row a layer has, for each
state, the least cost and the audit string of it, the initials of its edits; ties go to the string that is least in
ASCII order. Two rounds of inserts close a layer, as two reach every state that can be reached. Strings of one layer
that end in a row's letter all hold as many of these letters, so none begins another: their order is that of their
layer before and of what was added since, and ranks and back-pointers stand for the strings.

Rows are dealt by conversation, sorted there and streamed: a task holds four states, the digest of each state's text so
far and eight bytes a row of one conversation, never its texts, so that a conversation of any length fits, though one
task reads it: each step needs the one before, as does its SHA-256. Repeats are found by an aggregation of row hashes.

Defined cases: rows go by turn, nulls first, then by role, text and copy, so that ties and repeated rows have one
order. A null role or text is one space; a null conv_id is a conversation of its own. A role of other initials
than s, u and a can't be kept; an empty role has none. Long texts are hashed as they pass. A conversation without
rows has zeros, an empty audit and the hash of the empty string. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as tc

_SPACES = " \t\n\v\f\r"
#: Grammar states: nothing yet, a system turn, a user turn, an assistant turn; what may follow each, and where it leads.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEEDED = ("user", "user", "assistant", "user")
_ENDS = (0, 3)
_LETTERS = "DIKR"
_ORDER = ["conv_id", "turn", "role", "text", "copy"]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults by crc32 of conv_id:turn modulo 20; rows that are dropped are marked as gone."""
    key = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = (F.coalesce(F.col(k), F.lit(" ")) for k in ("text", "role"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _said(rows: DataFrame) -> list[Column]:
    """Two hashes of conversation, role and text."""
    what = [F.col("conv_id").isNull(), "conv_id", "role", "text"]
    return [F.xxhash64(*what).alias("h"), F.xxhash64(F.lit("other"), *what).alias("g")]


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows by conversation in their order, with their faults."""
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    copy = F.col("copy").cast("int") if "copy" in rows.columns else F.lit(0)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(k), F.lit(" ")).alias(k) for k in ("role", "text")), gone.alias("gone"), copy.alias("copy"))
    rows = rows.select("*", *_said(rows))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.where(~F.col("gone")).groupBy("h", "g").agg(F.min(when).alias("first"))
    core = F.rtrim("text", F.lit(_SPACES))
    blank = core == ""
    rows = rows.join(first, ["h", "g"], "left").select(
        *_ORDER, "gone", blank.alias("blank"), F.coalesce(when > F.col("first"), F.lit(False)).alias("seen"), (~blank & ~F.substring(core, -1, 1).isin(*".!?")).alias("cut")
    )
    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER)


class _Digest:
    """SHA-256 of lines, without a line feed before the first."""

    def __init__(self, of: Any = None, some: bool = False) -> None:
        self.of, self.some = of or hashlib.sha256(), some

    def then(self, role: str, text: str) -> _Digest:
        of = self.of.copy()
        of.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        return _Digest(of, True)


class _Chain:
    """The layers of one conversation. A path is (cost, (rank of the state it comes from, letters since), that state, digest)."""

    def __init__(self) -> None:
        self.layers = array("Q")
        self.now: list[tuple | None] = [None] * 4
        self._close([(0, (0, ""), 0, _Digest()), None, None, None], [0] * 4)

    def _close(self, base: list[tuple | None], came: list[int]) -> None:
        """Ranks the paths that end with the row's letter and adds inserts; came: letter and state before of each."""
        rank = {p[1]: k for k, p in enumerate(sorted((p for p in base if p), key=lambda p: p[1]))}
        now = [(p[0], (rank[p[1]], ""), s, p[3]) if p else None for s, p in enumerate(base)]
        for _ in range(2):
            before = list(now)
            for s, p in enumerate(before):
                if p:
                    t = _NEXT[s, _NEEDED[s][0]]
                    cost, key = p[0] + 5, (p[1][0], p[1][1] + "I")
                    if now[t] is None or (cost, key) < now[t][:2]:
                        now[t] = (cost, key, p[2], p[3].then(_NEEDED[s], ""))
        self.now = now
        packed = 0
        for s, p in enumerate(now):
            packed |= ((came[s] << 4) | ((p[2] << 2) | len(p[1][1]) if p else 0)) << 8 * s
        self.layers.append(packed)

    def row(self, role: str, text: str, must_go: bool, cut: bool) -> None:
        base: list[tuple | None] = [None] * 4
        came, stays = [0] * 4, 5 if cut else 0
        found = [(s, s, p[0] + 2, "D", None) for s, p in enumerate(self.now) if p]
        if not must_go:
            for s, p in enumerate(self.now):
                if p:
                    if (t := _NEXT.get((s, role[:1]))) is not None:
                        found.append((s, t, p[0] + stays, "K", role))
                    found.append((s, _NEXT[s, _NEEDED[s][0]], p[0] + 1 + stays, "R", _NEEDED[s]))
        best: list[tuple | None] = [None] * 4
        for s, t, cost, letter, said in found:
            rank, since = self.now[s][1]
            new = (cost, (rank, since + letter), s, said)
            if best[t] is None or new[:2] < best[t][:2]:
                best[t] = new
        for t, new in enumerate(best):
            if new:
                cost, key, s, said = new
                base[t] = (cost, key, t, self.now[s][3] if said is None else self.now[s][3].then(said, text))
                came[t] = (_LETTERS.index(key[1][-1]) << 2) | s
        self._close(base, came)

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest path that ends in a whole conversation."""
        s = min((s for s in _ENDS if self.now[s]), key=lambda s: self.now[s][:2])
        cost, digest, out = self.now[s][0], self.now[s][3], []
        for k in range(len(self.layers) - 1, -1, -1):
            mine = self.layers[k] >> 8 * s
            base, inserts = mine >> 2 & 3, mine & 3
            out.append("I" * inserts)
            if k:
                came = self.layers[k] >> 8 * base + 4
                out.append(_LETTERS[came >> 2 & 3])
                s = came & 3
        return cost, "".join(reversed(out)), digest.of.hexdigest()


class _Conversation:
    """What is counted over the rows of one conversation as they pass."""

    def __init__(self) -> None:
        self.chain, self.faults, self.illegal = _Chain(), [0, 0, 0], 0
        self.turns, self.low, self.high, self.before = 0, None, None, None

    def row(self, turn: int | None, role: str, text: str, blank: bool, seen: bool, cut: bool) -> None:
        before = self.before
        repeat = seen or (before is not None and before == (turn, role, text))
        for k, fault in enumerate((blank, repeat and not blank, cut and not repeat)):
            self.faults[k] += fault
        if before is not None and before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.before = (turn, role, text)
        self.chain.row(role, text, blank or repeat, cut)

    def report(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.faults, self.illegal, *self.chain.end()


def _report(kind: T.DataType) -> T.StructType:
    longs = [T.StructField(k, T.LongType()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return T.StructType([T.StructField("conv_id", kind), *longs, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def reports(rows: DataFrame) -> DataFrame:
    """Of each conversation its gaps and faults, the cost and audit of its repair, and the SHA-256 of what that gives.

    rows: conv_id, turn, role and text; where there is a column gone, rows for which it is true count as absent, and copy
    orders equal rows.
    """
    tc.tune(rows.sparkSession)
    names = ["turn", "role", "text", "blank", "seen", "cut"]
    schema = _report(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, done = None, None, []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, gone, *row in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "gone", *names)), strict=True):
                if conv is None or c != at:
                    if conv is not None:
                        done.append((at, *conv.report()))
                    conv, at = _Conversation(), c
                if not gone:
                    conv.row(*row)
            if done:
                yield _batch(done, kind)
                done = []
        if conv is not None:
            yield _batch([(at, *conv.report())], kind)

    def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=schema.names)

    return _sorted(rows).mapInArrow(run, schema)


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, place (from 0), role, text and edit (K, R or I). report: as :func:`reports` gives for the rows."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("place", T.LongType()), *(T.StructField(k, T.StringType()) for k in ("role", "text", "edit"))])
    ordered = _sorted(rows).where(~F.col("gone")).select(*_ORDER, F.lit(None).cast("string").alias("audit"))
    plan = report.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(-1).alias("copy"), "audit")
    both = ordered.unionByName(plan).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, 0, 0
        for batch in batches:
            out: list[tuple] = []

            def put(conv: Any, role: str, text: str, edit: str) -> None:
                nonlocal state, place
                out.append((conv, place, role, text, edit))
                state, place = _NEXT[state, role[:1]], place + 1

            for conv, role, text, plan in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text", "audit")), strict=True):
                if plan is not None:
                    audit, at, state, place = plan, 0, 0, 0
                else:
                    if audit[at] != "D":
                        put(conv, role if audit[at] == "K" else _NEEDED[state], text, audit[at])
                    at += 1
                while audit[at : at + 1] == "I":
                    put(conv, _NEEDED[state], "", "I")
                    at += 1
            if out:
                types = [batch.schema.field("conv_id").type, pa.int64(), *[pa.string()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    return both.mapInArrow(run, schema)
