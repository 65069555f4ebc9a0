"""Cross-references: citations found by a table of ordered patterns, resolved by joins.

What a text cites is found in Arrow batches of texts, without knowing the corpus. Which paragraph that is, is a matter of
joins: by unit, by the marker a target has and by the markers above it, with fallbacks by priority.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import storage
from tessella.functions import text as X

#: Regulations that have a corpus of their own; how an act is cited.
KNOWN = {"Regulation (EU) 2016/679": "gdpr", "Regulation (EU) 2024/1689": "aiact"}
ACT = r"Regulation\s+\((?:EU|EC|EEC)\)(?:\s+No)?\s+\d+/\d+|Directive\s+(?:\((?:EU|EC|EEC)\)\s+)?\d+/\d+/\w+|Decision\s+(?:\((?:EU|EC|EEC)\)\s+)?(?:No\s+)?\d+/\d+(?:/\w+)?"
_NUMBERS = r"(?P<more>(?:\s*(?:,|and|or|to)\s*\d+)*)"
#: The citations, in the order in which they claim their places.
PATTERNS = (
    ("article", rf"\bArticles?\s+(?P<n>\d+)(?P<marks>(?:\(\d+\))?(?:\([a-z]\))?(?:\((?:{X.ROMAN})\))?){_NUMBERS}(?:\s+of\s+(?P<act>{ACT}))?"),
    ("annex", rf"\bAnnex(?:es)?\s+(?P<n>[IVXLCDM]+|\d+)(?:\s+of\s+(?P<act>{ACT}))?"),
    ("paragraph", rf"\b[Pp]aragraphs?\s+(?P<n>\d+){_NUMBERS}"),
    ("point", rf"\b[Pp]oints?\s+(?P<marks>\([a-z]\)(?:\((?:{X.ROMAN})\))?)(?P<more>(?:\s*(?:,|and|or)\s*\([a-z]\))*)(?:\s+of\s+Article\s+(?P<n>\d+)(?P<under>\(\d+\))?)?"),
    ("regulation", r"\bRegulation\s+\((?:EU|EC|EEC)\)(?:\s+No)?\s+\d+/\d+"),
    ("directive", r"\bDirective\s+(?:\((?:EU|EC|EEC)\)\s+)?\d+/\d+/\w+"),
    ("structural", r"\b(?P<name>Chapter|Section|Title)\s+(?:[IVXLCDM]+|\d+)"),
)
_COMPILED = tuple((kind, re.compile(pattern)) for kind, pattern in PATTERNS)
_FIELDS = "place int, raw string, short_raw string, kind string, member boolean, act string, unit_number string, markers array<string>, surface string"


def numbers_in(first: int, chain: str) -> Iterator[int]:
    """The numbers after the first in a chain such as ', 17 and 19 to 21', with all of a range."""
    ends = [(word, int(n)) for word, n in re.findall(r"(,|and|or|to)\s*(\d+)", chain)]
    for (_, before), (word, n) in itertools.pairwise([("", first), *ends]):
        yield from range(before + 1, n + 1) if word == "to" else (n,)


def _paragraph_marks(marks: str) -> list[str]:
    """'(1)(a)(i)' as the markers of paragraphs and points, '1.', '(a)' and '(i)'."""
    return [f"{m[1:-1]}." if m[1:-1].isdigit() else m for m in re.findall(r"\([^()]*\)", marks)]


def _members(kind: str, m: re.Match) -> Iterator[tuple[str, str, str | None, list[str]]]:
    """raw, raw without the article, unit and markers of the others in a chain."""
    part = m.groupdict()
    if kind == "point":
        for letter in re.findall(r"\([a-z]\)", part["more"]):
            own = [*_paragraph_marks(part["under"] or ""), letter]
            yield f"point {letter}" + (f" of Article {part['n']}" if part["n"] else ""), f"point {letter}", part["n"], own
    elif kind in ("article", "paragraph"):
        for n in numbers_in(int(part["n"]), part["more"]):
            yield f"{kind.capitalize() if kind == 'article' else kind} {n}", "", str(n) if kind == "article" else None, [] if kind == "article" else [f"{n}."]


def references(text: str | None) -> list[tuple]:
    """place, raw, raw without the article, kind, member of a chain, act, unit number, markers and surface of each citation, in the order of the patterns.

    A citation inside one of an earlier pattern, or with a raw text that has been, is passed over and claims no place; members of a
    chain share the place of its head.
    """
    text, seen, taken, out = text or "", set(), [], []
    for kind, pattern in _COMPILED:
        for m in pattern.finditer(text):
            part, span = m.groupdict(), m.span()
            inside = any(a <= span[0] and span[1] <= b for a, b in taken)
            act = re.sub(r"\bNo\s+", "", " ".join((part.get("act") or m[0]).split())) if part.get("act") or kind == "regulation" else None
            name = part["name"].lower() if kind == "structural" else kind
            marks = [*_paragraph_marks(part.get("under") or ""), *_paragraph_marks(part.get("marks") or "")] if kind != "paragraph" else [f"{part['n']}."]
            if inside and kind not in ("article", "annex"):
                continue
            if m[0] not in seen and not inside:
                seen.add(m[0])
                taken.append(span)
                out.append((len(out), m[0], m[0], name, False, act, part.get("n") if kind != "paragraph" else None, marks, m[0]))
            for raw, short, unit, own in _members(kind, m):
                out.append((len(out), raw, short or raw, name, True, act, unit, own, m[0]))
    return out


def extract(paragraphs: DataFrame) -> DataFrame:
    """source, unit_id, paragraph_index and the citations of each paragraph, as they are found."""
    keys = ("source", "unit_id", "paragraph_index")
    rows = paragraphs.select(*keys, "text")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").dictionary_encode()
            each = [references(t) for t in texts.dictionary.to_pylist()]
            found = [r for x in each for r in x]
            if found:
                # a different text is read once a batch, and what it cites repeated in the order of the rows
                size = np.array([*map(len, each), 0])
                own = texts.indices.fill_null(len(each)).to_numpy()
                n = size[own]
                row = np.repeat(np.arange(len(own)), n)
                place = np.repeat((np.cumsum(size) - size)[own] - (np.cumsum(n) - n), n) + np.arange(len(row))
                at, place = pa.array(row), pa.array(place)
                arrays = [pa.array(x, t).take(place) for x, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *arrays], names=[*keys, *(f.split()[0] for f in _FIELDS.split(", "))])

    return rows.mapInArrow(run, f"{kinds}, {_FIELDS}")


def paragraph_index(paragraphs: DataFrame) -> DataFrame:
    """One row for each source, unit and index, with the marker of its text and those above it; of repeated rows the last by text.

    paragraphs: source, unit_id, paragraph_index, iri, text and parent_text.
    """
    key = ["source", "unit_id", "paragraph_index"]
    one = paragraphs.groupBy(*key).agg(F.max(F.struct("text", "iri", "parent_text", *(["screen_keep"] if "screen_keep" in paragraphs.columns else []))).alias("p"))
    out = one.select(*key, "p.*")
    chain = X.marker_chain(F.col("parent_text"))
    return out.withColumns({"marker": X.leading_marker(F.col("text")), "chain": chain})


def text_index(paragraphs: DataFrame) -> DataFrame:
    """source, unit_id, text and the last index at which a unit has this text."""
    return paragraphs.groupBy("source", "unit_id", "text").agg(F.max("paragraph_index").alias("paragraph_index"))


def parent_chain(paragraphs: DataFrame) -> DataFrame:
    """source, unit_id, paragraph_index and parents, an array of struct(iri, text) in the order of the lead-ins.

    A lead-in is the paragraph of the unit that has its text, if any. A continuation without lead-ins is below the
    paragraph whose identifier its own continues.
    """
    key = ["source", "unit_id", "paragraph_index"]
    lines = paragraphs.where("parent_text is not null and parent_text <> ''").select(*key, F.posexplode(F.split("parent_text", "\n")).alias("at", "line"))
    named = text_index(paragraphs).withColumnRenamed("paragraph_index", "found").join(paragraphs.select("source", "unit_id", F.col("paragraph_index").alias("found"), "iri"), ["source", "unit_id", "found"])
    met = lines.join(named.select("source", "unit_id", F.col("text").alias("line"), "iri"), ["source", "unit_id", "line"], "left")
    chains = met.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "iri", "line"))), lambda x: F.struct(x["iri"].alias("iri"), x["line"].alias("text"))).alias("parents"))
    above = paragraphs.where("(parent_text is null or parent_text = '') and iri like '%/cont\\\\_%'").select(*key, F.regexp_replace("iri", r"/cont_(?!.*/cont_).*$", "").alias("up"))
    above = above.join(paragraphs.select(F.col("iri").alias("up"), "text"), "up").select(*key, F.array(F.struct(F.col("up").alias("iri"), "text")).alias("parents"))
    return paragraphs.select(*key).join(chains.union(above), key, "left")


def _find(tries: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """key and iri: of each key the paragraph found by the try of least priority, the first in its unit.

    tries: key, t_source, t_unit, priority and markers; the last marker is the paragraph's own, and the chain above it ends
    with the others.
    """
    last, rest = F.element_at("markers", -1), F.slice("markers", 1, F.size("markers") - 1)
    tries = tries.where("size(markers) > 0").withColumns({"marker": last, "above": rest})
    p = index.select(F.col("source").alias("t_source"), F.col("unit_id").alias("t_unit"), "marker", "chain", F.col("paragraph_index").alias("t_index"), F.col("iri").alias("t_iri"))
    met = tries.join(p, ["t_source", "t_unit", "marker"])
    tail = F.slice("chain", F.greatest(F.size("chain") - F.size("above") + 1, F.lit(1)), F.size("above"))
    met = met.where((F.size("above") == 0) | ((F.size("chain") >= F.size("above")) & (tail == F.col("above"))))
    return met.groupBy(*key).agg(F.min_by("t_iri", F.struct("priority", "t_index")).alias("found"))


def resolve(found: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The citations with resolved_iri and the text of what they cite: source, unit_id, paragraph_index, place, raw, kind, surface, resolved_iri, text.

    An article or annex is its first paragraph, or the one that its markers name: as they are, 'N.' as '(N)', and in units
    without paragraph markers with a leading first paragraph left out. A point without an article is one of the unit, as its markers are.
    Citations of unknown acts, or units that are not there, name nothing, nor do others of their chain, which are left out. Of equal raw
    texts the first stays, and an article goes where a point below it is cited. The text is there for
    paragraphs of the same corpus that were kept (screen_keep, where the paragraphs have it).
    """
    spark, key = found.sparkSession, ["source", "unit_id", "paragraph_index", "place"]
    n = storage.parts(spark, 3 * paragraphs.count())  # paragraphs with some citations each
    index = paragraph_index(paragraphs.repartition(n, "source", "unit_id"))
    known = F.broadcast(spark.createDataFrame(list(KNOWN.items()), "act string, to string"))
    there = index.groupBy(F.col("source").alias("t_source"), F.col("unit_id").alias("t_unit")).agg(F.max(F.coalesce(F.col("marker").rlike(r"^(?:\d+\.|\(\d+\))$"), F.lit(False))).alias("numbered"), F.min_by("iri", "paragraph_index").alias("first_iri"), F.max(F.when(F.col("paragraph_index") == 0, F.col("iri"))).alias("zero_iri"))
    rows = found.join(known, "act", "left").withColumn("t_source", F.when(F.col("act").isNull(), F.col("source")).otherwise(F.col("to")))
    named = F.when(F.col("kind") == "annex", F.concat(F.lit("anx_"), "unit_number")).when(F.col("kind").isin("article", "point"), F.concat(F.lit("art_"), "unit_number")).when(F.col("kind") == "paragraph", F.col("unit_id"))
    # what names no unit, or nothing, is dealt by its own: as nulls all of it would meet in one task
    own = F.coalesce("t_unit", F.concat(F.lit("\0"), "unit_id"))
    rows = rows.withColumn("t_unit", named).withColumn("_unit", own).repartition(n, "t_source", "_unit")
    rows = rows.join(there.withColumnRenamed("t_unit", "_unit"), ["t_source", "_unit"], "left").drop("_unit").withColumn("exists", F.col("zero_iri").isNotNull() | F.col("first_iri").isNotNull())
    # a point of an article that isn't there is one of the own unit
    local = (F.col("kind") == "point") & ~F.col("exists")
    rows = rows.withColumns({"local": local, "raw": F.when(local, F.col("short_raw")).otherwise(F.col("raw")), "t_source": F.when(local, F.col("source")).otherwise(F.col("t_source")), "t_unit": F.when(local, F.col("unit_id")).otherwise(F.col("t_unit")), "markers": F.when(local, F.filter("markers", lambda m: ~m.rlike(r"^\d+\.$"))).otherwise(F.col("markers"))})
    # all that follows groups by paragraph: one shuffle by it serves every window
    rows = rows.repartition(n, *(F.col(k) for k in key[:3]))
    heads = F.max(F.when(~F.col("member") & (F.col("kind") == "article"), F.col("exists"))).over(Window.partitionBy(*key[:3], "surface"))
    rows = rows.withColumn("head_exists", heads).where(~(F.col("member") & (F.col("kind") == "article") & ~F.coalesce("head_exists", F.lit(False))))
    rows = rows.withColumn("once", F.min("place").over(Window.partitionBy("source", "unit_id", "paragraph_index", "raw"))).where("place = once")
    first = F.get("markers", F.lit(0))
    none = F.lit(None).cast("array<string>")
    swapped = F.when(first.rlike(r"^\d+\.$"), F.concat(F.array(F.regexp_replace(first, r"^(\d+)\.$", "($1)")), F.slice("markers", 2, F.size("markers"))))
    implicit = first.isin("1.", "(1)") & ~F.coalesce("numbered", F.lit(False))
    shorter = F.when(implicit & (F.size("markers") > 1), F.slice("markers", 2, F.size("markers")))
    marked = rows.where("size(markers) > 0 and t_unit is not null")
    tries = marked.select(*key, "t_source", "t_unit", F.posexplode(F.array(F.col("markers"), F.when(F.col("local"), none).otherwise(swapped), F.when(F.col("local"), none).otherwise(shorter))).alias("priority", "markers")).where("markers is not null")
    tried = _find(tries.repartition(n, "t_source", "t_unit", F.element_at("markers", -1)), index, key)
    out = rows.join(tried.repartition(n, *key[:3]), key, "left")
    whole = F.when((F.size("markers") == 0) & F.col("kind").isin("article", "annex"), F.col("zero_iri"))
    chapeau = F.when(implicit & (F.size("markers") == 1) & ~F.col("local") & F.col("kind").isin("article", "paragraph", "point"), F.col("first_iri"))
    act = F.when((F.col("kind") == "regulation") & F.col("to").isNotNull(), F.concat("to", F.lit(":")))
    out = out.withColumn("resolved_iri", F.coalesce("found", chapeau, whole, act))
    # an article that only says where a cited point is
    points = F.collect_set(F.when(F.col("kind") == "point", F.col("resolved_iri"))).over(Window.partitionBy(*key[:3]))
    out = out.withColumn("points", points)
    covered = (F.col("kind") == "article") & F.coalesce(F.exists("points", lambda p: p.startswith(F.concat("resolved_iri", F.lit("/")))), F.lit(False))
    kept = index.where("screen_keep") if "screen_keep" in index.columns else index
    out = out.where(~covered).withColumn("_iri", F.coalesce("resolved_iri", F.concat(F.lit("\0"), "unit_id"))).repartition(n, "source", "_iri").join(kept.repartition(n, "source", "iri").select(F.col("source").alias("k_source"), F.col("iri").alias("k_iri"), F.col("text")), (F.col("k_iri") == F.col("_iri")) & (F.col("k_source") == F.col("source")), "left")
    return out.select(*key, "raw", "kind", "surface", "resolved_iri", "text")
