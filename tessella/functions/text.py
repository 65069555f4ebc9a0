"""Column functions on legal text; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small roman numerals, longer ones first.
ROMAN = "xviii|xvii|xvi|xv|xiv|xiii|xii|xi|x|ix|viii|vii|vi|v|iv|iii|ii|i"
#: Stop words of the content-token set.
STOP = ("the", "a", "an", "of", "for", "to", "in", "or", "and", "is", "are", "be", "by", "with", "which", "that", "as", "on", "shall", "not")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def leading_marker(text: Column) -> Column:
    """The enumeration marker that opens a text, 'N.', '(iv)', '(N)' or '(a)', else null."""
    return F.coalesce(_found(text, r"^\s*(\d+\.)(?=\s|$)"), _found(text, rf"^\s*(\((?:{ROMAN})\))(?=\s|$)"), _found(text, r"^\s*(\(\d+\))(?=\s|$)"), _found(text, r"^\s*(\([a-z]\))(?=\s|$)"))


def marker_segment(marker: Column) -> Column:
    """'N.' and '(N)' become par_N, '(x)' becomes pt_x."""
    number, letter = _found(marker, r"^\(?(\d+)[.)]$"), _found(marker, r"^\(([^)]*[^0-9)][^)]*)\)$")
    return F.when(number.isNotNull(), F.concat(F.lit("par_"), number)).when(letter.isNotNull(), F.concat(F.lit("pt_"), letter))


def marker_chain(parent_text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(parent_text, F.lit("")), "\n"), leading_marker), lambda m: m.isNotNull())


def clean_heading(heading: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(heading, r"`+\s*$", "")), F.lit(""))


def content_tokens(text: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Distinct runs of a-z in lower case without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike, one empty one is unlike any other."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def containment(small: Column, big: Column, least: float) -> Column:
    return (F.size(small) > 0) & (F.size(F.array_intersect(small, big)) >= least * F.size(small))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What the body makes of a value that is worked out once; written out, Spark works it out at each place where it stands in a lambda."""
    return F.transform(F.array(value), body)[0]


def stem(word: Column) -> Column:
    """One ending of ing, ed, es, s less, if three letters stay."""
    out = word
    for end in ("s", "es", "ed", "ing"):
        out = F.when(word.endswith(end) & (F.length(word) >= 3 + len(end)), F.regexp_replace(word, f"{end}$", "")).otherwise(out)
    return out


#: Determiners, of which one may lead a phrase.
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those")


def plain_form(text: Column) -> Column:
    """Straight quotes, single spaces, no outer '.;,', lower case, one leading determiner less; compatibility characters stay as they are."""
    t = F.translate(F.coalesce(text, F.lit("")), "‘’“”", "''\"\"")
    t = F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), "^[.;,]+|[.;,]+$", "")))
    return F.regexp_replace(t, rf"^(?:{'|'.join(DETERMINERS)})\s+(?=\S)", "")


def article_root(iri: Column) -> Column:
    return F.split(iri, "/par_")[0]


def regulation(iri: Column) -> Column:
    return F.split(iri, ":")[0]


def normalise_citation(text: Column) -> Column:
    """Single spaces, and no 'No' before the number."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\bNo ", "")


def defined_terms(text: Column) -> Column:
    """Quoted terms of 2 to 80 characters in parentheses."""
    return F.regexp_extract_all(text, F.lit("\\([^()]*?['\"\u2018\u201c]([^'\"\u2019\u201d]{2,80})['\"\u2019\u201d][^()]*?\\)"), F.lit(1))


#: Where a camel-case name is split, after a small letter or digit, and before the last capital of several.
CAMEL = (r"(?<=[a-z0-9])(?=[A-Z])", r"(?<=[A-Z])(?=[A-Z][a-z])")


def delabel(curie: Column) -> Column:
    """Words of a camel-case local name in lower case."""
    local = F.regexp_replace(curie, r"^[^:]*:", "")
    spaced = F.regexp_replace(F.regexp_replace(local, CAMEL[0], " "), CAMEL[1], " ")
    return F.lower(F.regexp_replace(spaced, "_", " "))


def shorten(iri: Column, namespaces: dict[str, str]) -> Column:
    """A compact name by the first namespace that fits."""
    out = iri
    for prefix, base in reversed(list(namespaces.items())):
        out = F.when(iri.startswith(base), F.concat(F.lit(f"{prefix}:"), F.substr(iri, F.lit(len(base) + 1)))).otherwise(out)
    return out


def unconditional(conditions: Column) -> Column:
    return ~F.exists(conditions, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def contains_any(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(m.lower())) for m in markers), F.lit(False))


def serialize(subject: Column, modal: Column, predicate: Column, obj: Column, condition: Column) -> Column:
    """'S modal P O, where C.' with a capital first and no empty parts."""
    body = F.concat_ws(" ", F.array_join(subject, " and "), modal, F.array_join(predicate, " and "), F.array_join(obj, " and "))
    body = F.when(F.coalesce(F.trim(condition), F.lit("")) != "", F.concat(body, F.lit(", where "), condition)).otherwise(body)
    return F.concat(F.upper(F.substring(body, 1, 1)), F.substr(body, F.lit(2)), F.lit("."))
