"""Normalising phrases and predicates, as column expressions over fixed word lists."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import DETERMINERS, let

#: Deontic scaffolding in front of a verb, and adverbs that may stand between.
PERIPHRASES = ("shall have the obligation to", "has the obligation to", "shall have the right to", "is not required to", "is required to")
SCAFFOLD = ("shall", "may", "must", "can", "be", "been", "being", "to")
ADVERBS = ("further", "duly", "promptly", "reasonably", "directly", "effectively", "specifically")
NEGATIVE = ("DISPENSATION", "PROHIBITION")
#: Irregular verb forms that rules on endings don't give.
IRREGULAR = {"taken": "take", "took": "take", "given": "give", "made": "make", "kept": "keep", "held": "hold", "laid": "lay", "drawn": "draw", "set": "set", "put": "put", "has": "have", "had": "have", "is": "be", "are": "be", "was": "be", "were": "be", "does": "do", "did": "do", "done": "do", "chosen": "choose", "sent": "send", "met": "meet", "borne": "bear", "undertaken": "undertake", "brought": "bring", "sought": "seek", "known": "know", "shown": "show", "withdrawn": "withdraw", "used": "use", "using": "use"}
#: What is left of a verb without its ending takes an e after these, but not after those.
_TAKES_E = r"(?:[^aeiou]l|[aeiou][^aeiouwxyl]|[^aeiou]r|rc|rs|ns|nc|rg|ng|dg|u|v|z|c)$"
_TAKES_NONE = r"(?:er|en|et|it|or|on|ain|eal|ect|ent|ess|ish|ow|eat|eed|eep|oin|ail)$"
_END = r"(?![A-Za-z'])\s*"


def _words(*phrases: str) -> str:
    return "|".join(p.replace(" ", r"\s+") for p in phrases)


#: What may stand before the verb: of any statement, and of one whose modality is negative.
_PLAIN = f"(?i)^(?:(?:{_words(*(p for p in PERIPHRASES if ' not ' not in p), *SCAFFOLD)}){_END})*"
_NEGATED = f"(?i)^(?:(?:{_words(*PERIPHRASES, 'refrain from', 'abstain from', *SCAFFOLD, 'not')}){_END})*"
_CONTRADICTS = f"(?i)^(?:{_words(*(p for p in PERIPHRASES if ' not ' in p), 'not')}){_END}"
_HEAD = rf"(?is)^((?:(?:no longer|{'|'.join(ADVERBS)})[^A-Za-z ]* +)*)([A-Za-z']+)(.*)$"


def lemma(verb: Column) -> Column:
    """The base form of a verb in lower case, by a table of irregular forms and rules on endings; an approximation."""
    return let(F.lower(verb), _lemma)


def _lemma(w: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    out = F.when(w.endswith("s") & ~w.rlike("(?:ss|us|is)$") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)
    out = F.when(w.rlike("(?:s|x|z|ch|sh)es$"), F.regexp_replace(w, "es$", "")).otherwise(out)
    for end in ("ed", "ing"):
        base = F.regexp_replace(w, f"{end}$", "")
        doubled = (F.length(base) > 3) & base.rlike(r"([^lsz])\1$")
        plain = F.when(base.rlike(_TAKES_E) & ~base.rlike(_TAKES_NONE), F.concat(base, F.lit("e"))).otherwise(base)
        out = F.when(w.endswith(end) & (F.length(base) >= 3) & base.rlike("[aeiouy]"), F.when(doubled, F.regexp_replace(base, ".$", "")).otherwise(plain)).otherwise(out)
    out = F.when((F.length(w) > 4) & w.rlike("ie[sd]$"), F.regexp_replace(w, "ie[sd]$", "y")).otherwise(out)
    return F.coalesce(F.try_element_at(table, w), out)


def normalised(text: Column, modality: Column) -> Column:
    """struct(text, contradiction): the predicate without scaffolding, its verb in base form; and whether a negation contradicts the modality.

    A contradicting predicate stays as it is; null and blank ones too.
    """
    t = F.trim(text)
    negative = F.coalesce(F.upper(modality).isin(*NEGATIVE), F.lit(False))
    blank = F.coalesce(t == "", F.lit(True))

    def verb(rest: Column) -> Column:
        return let(F.regexp_extract(rest, _HEAD, 2), lambda head: F.when(head == "", rest).otherwise(F.trim(F.concat(F.regexp_extract(rest, _HEAD, 1), lemma(head), F.regexp_extract(rest, _HEAD, 3)))))

    def told(rest: Column) -> Column:
        return let(~negative & rest.rlike(_CONTRADICTS), lambda against: F.struct(F.when(blank, text).when(against, t).otherwise(verb(rest)).alias("text"), F.coalesce(~blank & against, F.lit(False)).alias("contradiction")))

    return let(F.when(negative, F.regexp_replace(t, _NEGATED, "")).otherwise(F.regexp_replace(t, _PLAIN, "")), told)


def normalise_text(text: str | None) -> str:
    """Compatibility form, straight quotes, single spaces, no outer '.;,', lower case, one leading determiner less."""
    t = unicodedata.normalize("NFKC", text or "").translate(str.maketrans("‘’“”", "''\"\""))
    t = " ".join(t.split()).strip(".;,").strip().lower()
    head, _, tail = t.partition(" ")
    return tail if tail and head in DETERMINERS else t


@F.pandas_udf(T.StringType())
def text_udf(text: pd.Series) -> pd.Series:
    """normalise_text on a column; in Python, as Spark has no compatibility form."""
    return text.map(normalise_text)
