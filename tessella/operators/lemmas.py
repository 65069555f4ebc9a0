"""Base forms of words by rules on endings, each accepted only where a lexicon has the base.

lexicon: word and n, how often it occurs, and where known pos, 'v' or 'n' (null: either); it is a vocabulary's labels, or
the corpus itself by :func:`lexicon`. Words meet it in joins of distinct words, so that nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.predicates import IRREGULAR

#: Endings of verbs and nouns with what takes their place, earlier ones first where the lexicon doesn't decide.
ENDINGS = {
    "v": (("ies", "y"), ("ied", "y"), ("s", ""), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "n": (("ies", "y"), ("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("ves", "f"), ("ves", "fe"), ("men", "man"), ("ices", "ix"), ("ices", "ex"), ("yses", "ysis"), ("eria", "erion")),
}
#: An s after these is no ending; letters of a base at least.
NO_ENDING, SHORTEST = "(?:s|u|i)s$", 3


def tokens(text: Column) -> Column:
    """Runs of a-z and digits in lower case; none of null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def lexicon(texts: DataFrame, column: str) -> DataFrame:
    """word and n: all words of the texts and how often they occur."""
    return texts.select(F.explode(tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def bases(word: Column, kind: str) -> Column:
    """Array of struct(place, base): what the word may come from as a verb ('v') or noun ('n'), the likelier earlier."""
    out = []
    for place, (ending, instead) in enumerate(ENDINGS[kind]):
        stays = F.substr(word, F.lit(1), F.length(word) - len(ending))
        fits = word.endswith(ending) & (F.length(stays) + len(instead) >= SHORTEST)
        if ending == "s":
            fits &= ~word.rlike(NO_ENDING)
        out.append(F.when(fits, F.struct(F.lit(place).alias("place"), F.concat(stays, F.lit(instead)).alias("base"))))
        if kind == "v" and ending in ("ed", "ing") and not instead:
            twice = fits & stays.rlike(r"([^aeiou])\1$") & (F.length(stays) > SHORTEST)
            out.append(F.when(twice, F.struct(F.lit(len(ENDINGS[kind]) + place).alias("place"), F.substr(word, F.lit(1), F.length(stays) - 1).alias("base"))))
    return F.array_compact(F.array(*out))


def lemma_table(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word and lemma of each distinct non-null word: its base as a verb, then the base of that as a noun.

    Of several bases in the lexicon the commonest wins, then the earlier rule; a word without one stays as it is.
    Irregular verbs go by their table.
    """
    table = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    has_kind = "pos" in lexicon.columns
    at = words.select("word").where("word is not null").distinct().select("word", F.col("word").alias("form"))
    for kind in ENDINGS:
        known = lexicon.where((F.col("pos") == kind) | F.col("pos").isNull()) if has_kind else lexicon
        known = known.groupBy(F.col("word").alias("base")).agg(F.sum("n").alias("n"))
        found = at.select("word", F.explode(bases(F.col("form"), kind)).alias("b")).select("word", "b.*").join(known, "base")
        found = found.groupBy("word").agg(F.max_by("base", F.struct("n", -F.col("place"))).alias("base"))
        irregular = F.try_element_at(table, F.col("form")) if kind == "v" else F.lit(None).cast("string")
        at = at.join(found, "word", "left").select("word", F.coalesce(irregular, "base", "form").alias("form"))
    return at.withColumnRenamed("form", "lemma")


def ungrounded(values: DataFrame, sources: DataFrame, lexicon: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """The values (id, field, value) with missing: their words in order, first ones of repeated ones, whose lemma no word of the source (id, text) has.

    Stop words count as grounded. Values without a source miss all of their words; those that are null or have no
    word miss none. Words of a source meet those of its values as rows of (id, lemma): no text's words are gathered.
    """
    words = F.array_except(tokens(F.col("value")), F.array(*(F.lit(w) for w in stop)))
    keyed = values.withColumn("_value", F.md5("value"))
    asked = keyed.where("id is not null").select("id", "_value", F.posexplode(words).alias("at", "word")).distinct()
    told = sources.join(asked.select("id").distinct(), "id", "left_semi").select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).distinct()
    table = lemma_table(asked.select("word").union(told.select("word")), lexicon)
    have = told.join(table, "word").select("id", "lemma").distinct()
    lost = asked.join(table, "word").join(have, ["id", "lemma"], "left_anti")
    lost = lost.groupBy("id", "_value").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("_lost"))
    missing = F.when(F.col("id").isNull(), words).otherwise(F.coalesce("_lost", F.array().cast("array<string>")))
    return keyed.join(lost, ["id", "_value"], "left").select(*values.columns, missing.alias("missing"))
