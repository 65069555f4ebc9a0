"""Roles of actors named in text, and the subjects of statements."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let

#: Nouns that end the label of an actor; stems of actors; the one phrase of each role.
ACTOR_NOUNS = ("officer", "officers", "controller", "controllers", "processor", "processors", "provider", "providers", "deployer", "deployers", "importer", "importers", "distributor", "distributors", "operator", "operators", "authority", "authorities", "body", "bodies", "subject", "subjects", "recipient", "recipients", "representative", "representatives", "party", "parties")
ACTOR_STEMS = ("controller", "processor", "data subject", "recipient", "third party", "representative", "provider", "deployer", "importer", "distributor", "operator", "authorit", "bod", "member state", "the commission", "the board", "ai office", "union institution")
ROLES = {"data subject": "the data subject", "supervisory authorit": "supervisory authorities", "member state": "Member States", "controller": "the controller", "processor": "the processor", "provider": "the provider", "deployer": "the deployer"}
BEARERS = {"market surveillance authorit": "the market surveillance authority", "conformity assessment bod": "the conformity assessment body", "supervisory authorit": "supervisory authorities", "certification bod": "the certification body", "notifying authorit": "the notifying authority", "notified bod": "the notified body", "member state": "Member States", "the commission": "the Commission", "data subject": "the data subject", "ai office": "the AI Office", "controller": "the controller", "processor": "the processor", "the board": "the Board", "provider": "the provider", "deployer": "the deployer"}
DEFAULT_BEARER = {"gdpr": "the controller", "aiact": "the provider"}
FOREIGN = {"gdpr": ("the deployer", "the provider"), "aiact": ("the controller", "the data subject", "the processor")}
#: Words that tell data from the scope of an exemption, and prepositions before one who doesn't act.
DATA_MARKERS = ("data", "information", "categor", "decision", "record", "content")
SCOPE_MARKERS = ("enterprise", "organisation", "organization", "body", "establishment", "established", "employing", "undertaking", "micro", "medium-sized")
PREPOSITIONS = ("to", "for", "of", "from", "by", "against", "upon")
_PASSIVE = r"(?is)^[^.;]{0,90}?\b(?:shall|may|must|should|cannot|can\s+not|is|are|were)\b[^.;]{0,90}?\b(?:be|been|being|remains?)\b"


def first_bearer(text: Column, stems: dict[str, str] = BEARERS) -> Column:
    """The role whose stem stands first in the text, the longest stem at one place, else null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*(F.struct(F.locate(s.lower(), t).alias("at"), F.lit(-len(s)).alias("length"), F.lit(role).alias("role")) for s, role in stems.items()))
    return F.array_min(F.filter(found, lambda x: x["at"] > 0))["role"]


def inferred_bearer(parents: Column, text: Column, stems: dict[str, str] = BEARERS) -> Column:
    """From the parents' texts, an array, in their order first, then the paragraph."""
    texts = F.concat(F.coalesce(parents, F.array().cast("array<string>")), F.array(text))
    return F.try_element_at(F.filter(F.transform(texts, lambda t: first_bearer(t, stems)), lambda r: r.isNotNull()), F.lit(1))


def snapped_role(value: Column, keywords: dict[str, str] = ROLES) -> Column:
    """The one role whose keywords the value contains; the value itself where there is none or more than one."""
    hits = lambda v: F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(v, F.lit(k.lower())), F.lit(role)) for k, role in keywords.items()))))
    return let(let(F.lower(F.coalesce(value, F.lit(""))), hits), lambda h: F.when(F.size(h) == 1, h[0]).otherwise(value))


def is_actor(label: Column, nouns: tuple[str, ...] = ACTOR_NOUNS) -> Column:
    return F.coalesce(F.element_at(F.split(F.lower(F.trim(label)), r"\s+"), -1).isin(*nouns), F.lit(False))


def actor_stems(labels: list[str]) -> list[str]:
    """The stems of actors and the labels, those of actors among a vocabulary's, the longest first."""
    return sorted({*ACTOR_STEMS, *(x.lower() for x in labels)}, key=lambda s: (-len(s), s))


def names_actor(value: Column, stems: list[str] | None = None) -> Column:
    """Whether a value contains the stem of an actor."""
    return F.coalesce(F.lower(value).rlike("|".join(re.escape(s) for s in stems or actor_stems([]))), F.lit(False))


def is_patient(subject: Column, text: Column) -> Column:
    """Whether the subject is acted upon: followed by a passive within its clause, or right after a preposition.

    The phrase is looked for whole, and where that tells nothing by its first three words.
    """
    t, whole = F.coalesce(text, F.lit("")), F.regexp_replace(F.trim(subject), "[.;,]+$", "")
    low = F.lower(t)

    def told(phrase: Column) -> Column:
        at = F.position(F.lower(phrase), low)
        after = F.substr(t, at + F.length(phrase))
        before = F.lower(F.regexp_extract(F.substr(t, F.lit(1), F.greatest(at - 1, F.lit(0))), r"(\S+)\s*$", 1))
        return (at > 0) & (after.rlike(_PASSIVE) | before.isin(*PREPOSITIONS))

    return F.coalesce((whole != "") & (told(whole) | told(F.array_join(F.slice(F.split(whole, r"\s+"), 1, 3), " "))), F.lit(False))


def dropped_slot(modality: Column, value: Column) -> Column:
    """The slot in which a subject that doesn't act belongs: condition, object, or null where that would be a guess."""
    v = F.lower(F.coalesce(value, F.lit("")))
    has = lambda markers: v.rlike("|".join(markers))
    return F.when(modality == "DISPENSATION", "condition").when(modality.isin("OBLIGATION", "PROHIBITION"), "object").when(modality == "PERMISSION", F.when(has(SCOPE_MARKERS), "condition").when(has(DATA_MARKERS), "object"))
