"""Concepts for the values of slots: exact, synonym, lexical, alias, tag and nearest matches, and what becomes of a value.

values: slot, regulation, value, article, n and paragraphs; labels: slot, regulation, iri and label, the routed vocabulary. Words and lemmas
are arrays made once for each different phrase. Phrases meet by their words: a label is looked for by its rarest
word alone, so that a common word pairs nothing, and then verified whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import predicates
from tessella.functions import text as X
from tessella.operators import matching, retrieve

#: Words that carry no concept, and those that lead a noun which the word before governs.
STOP = ("i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her", "it", "its", "they", "them", "their", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "should", "now")
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those", "each", "every", "any", "all", "no", "one", "its", "his", "her", "their", "our", "your", "my")
#: The least score of an object that maps by itself, the nearest ones looked at, and the candidates kept.
IDF_FLOOR, NEAREST, MOST_CANDIDATES = 3.0, 20, 6
KEY = ("slot", "regulation")


def words(phrase: Column) -> Column:
    """The words of a phrase in plain form."""
    return F.filter(F.split(X.plain_form(phrase), " "), lambda w: w != "")


def noun(word: Column) -> Column:
    """A noun in the singular, by rules on endings; an approximation."""
    return F.when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(?:s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.endswith("s") & ~word.rlike("(?:ss|us|is)$") & (F.length(word) > 3), F.regexp_replace(word, "s$", "")).otherwise(word)


def noun_lemmas(phrase: Column) -> Column:
    """The set of nouns in the singular, without stop words; not, no and nor stay."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(words(phrase), lambda w: ~w.isin(*STOP)), noun)))


def head_lemmas(phrase: Column) -> Column:
    """The set of verbs in base form that don't govern a noun with a determiner right after them."""
    w = words(phrase)
    following = F.slice(F.concat(w, F.array(F.lit(""))), 2, F.greatest(F.size(w), F.lit(1)))
    kept = F.filter(F.zip_with(w, following, lambda a, b: F.when(a.isNotNull() & ~b.isin(*DETERMINERS), a)), lambda x: x.isNotNull())
    return F.array_distinct(F.transform(kept, predicates.lemma))


# ---- vocabularies


def routed(terms: DataFrame, routing: DataFrame, abstract: DataFrame | None = None) -> DataFrame:
    """slot, regulation, iri and label of the terms that a route selects: all of a vocabulary, those of a scheme or below a root.

    terms: vocab, iri, label, scheme and root; routing: slot, regulation, vocab, by, value and sequence. A term
    selected twice has the label of the later route. Abstract terms (iri) are never a target.
    """
    r, t = routing.alias("r"), terms.alias("t")
    fits = (F.col("r.by") == "all") | ((F.col("r.by") == "scheme") & (F.col("t.scheme") == F.col("r.value"))) | ((F.col("r.by") == "root") & (F.col("t.root") == F.col("r.value")))
    hits = t.join(F.broadcast(r), (F.col("t.vocab") == F.col("r.vocab")) & fits)
    out = hits.groupBy(F.col("r.slot").alias("slot"), F.col("r.regulation").alias("regulation"), F.col("t.iri").alias("iri")).agg(F.max_by("t.label", F.col("r.sequence")).alias("label"))
    return out if abstract is None else out.join(abstract.select("iri").distinct(), "iri", "left_anti").select(*KEY, "iri", "label")


def adjudicable(labels: DataFrame, terms: DataFrame, scheme: str) -> DataFrame:
    """The routed labels that an adjudicator may choose: not those of a scheme, nor the numbered articles of a law."""
    gone = terms.where(F.col("scheme") == scheme).select("iri").distinct()
    return labels.join(gone, "iri", "left_anti").where(~F.col("iri").rlike(r":A\d+(-\d+)*(-|$)")).select(*labels.columns)


def own_terms(terms: DataFrame, prefix: str, label: Column) -> DataFrame:
    """The terms of a vocabulary's own namespace, those without a label named by ``label``."""
    return terms.where(F.col("iri").startswith(prefix)).withColumns({"label_derived": F.col("label").isNull(), "label": F.coalesce("label", label)})


def selector_counts(labels: DataFrame) -> DataFrame:
    """How many terms each slot and regulation routes to."""
    return labels.groupBy(*KEY).agg(F.countDistinct("iri").alias("n"))


# ---- matches; each gives slot, regulation, value, iri, score and rank (the order in which candidates are shown)


def _values(values: DataFrame) -> DataFrame:
    return values.select(*KEY, "value").distinct()


def exact_matches(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that are the value; and of predicates, labels of one word that is a verb of the value's head."""
    whole = labels.select(*KEY, "iri", F.array_join(words(F.col("label")), " ").alias("phrase")).groupBy(*KEY, "phrase").agg(F.min("iri").alias("iri"))
    v = _values(values).withColumn("phrase", F.array_join(words(F.col("value")), " "))
    same = v.join(whole, [*KEY, "phrase"]).select(*KEY, "value", "iri", F.lit(0).alias("rank"))
    single = labels.select(*KEY, "iri", noun_lemmas(F.col("label")).alias("l")).where("size(l) = 1").select(*KEY, "iri", predicates.lemma(F.col("l")[0]).alias("verb"))
    heads = v.where("slot = 'predicate'").select(*KEY, "value", F.explode(head_lemmas(F.col("value"))).alias("verb"))
    by_head = heads.join(single, [*KEY, "verb"]).select(*KEY, "value", "iri", F.lit(1).alias("rank"))
    return same.union(by_head).groupBy(*KEY, "value", "iri").agg(F.min("rank").alias("rank")).withColumn("score", F.lit(1.0))


def synonym_matches(values: DataFrame, labels: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Routed labels that a curated synonym (verb, iri) of a verb of a predicate's head names."""
    known = synonyms.select(predicates.lemma(F.col("verb")).alias("verb"), "iri").distinct()
    heads = _values(values).where("slot = 'predicate'").select(*KEY, "value", F.explode(head_lemmas(F.col("value"))).alias("verb"))
    return heads.join(F.broadcast(known), "verb").join(labels.select(*KEY, "iri").distinct(), [*KEY, "iri"]).select(*KEY, "value", "iri", F.lit(0).alias("rank"), F.lit(1.0).alias("score")).distinct()


def inverse_frequencies(labels: DataFrame) -> DataFrame:
    """slot, regulation, token and idf over the labels of each route."""
    l = labels.select(*KEY, "iri", noun_lemmas(F.col("label")).alias("tokens"))
    n = l.groupBy(*KEY).agg(F.count("*").alias("n"))
    df = l.select(*KEY, F.explode("tokens").alias("token")).groupBy(*KEY, "token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), list(KEY)).select(*KEY, "token", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def lexical_matches(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels all of whose words are in the value, by summed idf, without those inside another hit; of predicates those with a verb of the head."""
    out = None
    v, l = _values(values), labels.select(*KEY, "iri", "label")
    scored = matching.contained(v.withColumn("tokens", noun_lemmas(F.col("value"))), l.withColumn("tokens", noun_lemmas(F.col("label"))), inverse_frequencies(labels), list(KEY))
    verbs = F.transform(words(F.col("label")), predicates.lemma)
    out = scored.join(l, [*KEY, "iri"]).where((F.col("slot") != "predicate") | F.arrays_overlap(verbs, head_lemmas(F.col("value"))))
    return out.select(*KEY, "value", "iri", F.round("score", 3).alias("score"), F.lit(0).alias("rank"))


def alias_matches(values: DataFrame, labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Routed labels that a curated alias (phrase, iri) in an object names, by the label's summed idf.

    A phrase is looked for by the one of its words that fewest phrases have, and verified whole; one without words is in every value.
    """
    idf = inverse_frequencies(labels)
    weight = labels.select(*KEY, "iri", F.explode_outer(noun_lemmas(F.col("label"))).alias("token")).join(idf, [*KEY, "token"], "left").groupBy(*KEY, "iri").agg(F.round(F.coalesce(F.sum("idf"), F.lit(0.0)), 3).alias("score"))
    v = _values(values).where("slot = 'object'").withColumn("lemmas", noun_lemmas(F.col("value")))
    phrases = aliases.select("iri", noun_lemmas(F.col("phrase")).alias("own")).distinct()
    flat = phrases.select("iri", "own", F.explode("own").alias("token"))
    rare = flat.join(flat.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("iri", "own").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    met = v.select("*", F.explode("lemmas").alias("token")).join(rare, "token").where(F.size(F.array_except("own", "lemmas")) == 0)
    named = met.select(*KEY, "value", "iri").distinct().join(weight, [*KEY, "iri"])
    always = v.join(weight.join(phrases.where("size(own) = 0").select("iri").distinct(), "iri"), list(KEY))
    columns = [*KEY, "value", "iri", "score", F.lit(1).alias("rank")]
    return named.select(*columns).union(always.select(*columns)).distinct()


def tag_matches(values: DataFrame, labels: DataFrame, tags: DataFrame) -> DataFrame:
    """Labels that a tag of one of the value's paragraphs names: of equal words, else the shortest that hold all of the tag's.

    tags: paragraph and tag; values have paragraphs, an array.
    """
    l = labels.select(*KEY, "iri", noun_lemmas(F.col("label")).alias("own"))
    t = tags.select("paragraph", noun_lemmas(F.col("tag")).alias("tag")).where("size(tag) > 0").distinct()
    v = values.select(*KEY, "value", "article", F.explode("paragraphs").alias("paragraph")).distinct()
    named = v.join(t, "paragraph").select(*KEY, "value", "article", "tag").distinct()
    first = named.select(*KEY, "tag").distinct().withColumn("token", F.col("tag")[0])
    met = first.join(l.select(*KEY, "iri", "own", F.explode("own").alias("token")), [*KEY, "token"]).where(F.size(F.array_except("tag", "own")) == 0)
    shortest = F.min(F.size("own")).over(Window.partitionBy(*KEY, "tag"))
    best = met.withColumn("shortest", shortest).where("size(own) = shortest").select(*KEY, "tag", "iri")
    return named.join(best, [*KEY, "tag"]).select(*KEY, "value", "article", "iri").distinct()


def nearest_matches(vectors: DataFrame, label_vectors: DataFrame, k: int = NEAREST) -> DataFrame:
    """The k labels of nearest vectors, which are weak hints. vectors: slot, regulation, value and vector; label_vectors: slot, regulation, iri and vector."""
    score = F.round(retrieve.dot(F.col("q"), F.col("e")), 3)
    met = vectors.withColumnRenamed("vector", "q").join(label_vectors.withColumnRenamed("vector", "e"), list(KEY)).select(*KEY, "value", "iri", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy(*KEY, "value").orderBy(F.desc("score"), "iri"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def worksheet(values: DataFrame, labels: DataFrame, synonyms: DataFrame, aliases: DataFrame, tags: DataFrame, nearest: DataFrame | None = None, floor: float = IDF_FLOOR, most: int = MOST_CANDIDATES) -> DataFrame:
    """slot, regulation, value, article, n, status, lexical_hit, iri and candidates ('method:iri', in order) of each value.

    Exact and synonym hits map. An object maps to all lexical and alias hits that clear the floor, and is reviewed without such;
    a predicate or condition is reviewed if it has a hit, or its paragraph a tag, and else literal. Without any
    label for the slot there is no target.
    """
    exact = exact_matches(values, labels).withColumn("method", F.lit("exact"))
    synonym = synonym_matches(values, labels, synonyms).withColumn("method", F.lit("synonym"))
    lexical = lexical_matches(values, labels).withColumn("method", F.lit("lexical"))
    alias = alias_matches(values, labels, aliases).withColumn("method", F.lit("alias"))
    alias = alias.join(lexical.select(*KEY, "value", "iri"), [*KEY, "value", "iri"], "left_anti")
    key = [*KEY, "value"]
    own = lambda df, order, name: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("iri").alias("iri"), "method", "score"))).alias(name))
    out = values.select(*KEY, "value", "article", "n")
    parts = [("e", exact, ["rank"]), ("s", synonym, ["rank"]), ("x", lexical.unionByName(alias), [(-F.col("score")).alias("by"), "rank"])]
    if nearest is not None:
        parts.append(("d", nearest.select(*key, "iri", "score", "rank").withColumn("method", F.lit("embed")), ["rank"]))
    for name, df, order in parts:
        out = out.join(own(df, order, name), key, "left")
    tagged = tag_matches(values, labels, tags).groupBy(*key, "article").agg(F.array_sort(F.collect_set("iri")).alias("t"))
    out = out.join(tagged, [*key, "article"], "left").join(F.broadcast(labels.select(*KEY).distinct().withColumn("target", F.lit(True))), list(KEY), "left")
    named = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(x["method"].alias("method"), x["iri"].alias("iri"), x["score"].alias("score"))), F.array().cast("array<struct<method:string,iri:string,score:double>>"))
    lex, near = named(F.col("x")), named(F.col("d")) if nearest is not None else F.array().cast("array<struct<method:string,iri:string,score:double>>")
    iris = lambda c: F.transform(c, lambda x: x["iri"])
    weak = F.slice(F.concat(lex, F.filter(near, lambda x: ~F.array_contains(iris(lex), x["iri"]))), 1, most)
    sure = F.when(F.size("e") > 0, named(F.col("e"))).when(F.size("s") > 0, named(F.col("s")))
    strong = F.filter(lex, lambda x: x["score"] >= floor)
    maps = sure.isNotNull() | ((F.col("slot") == "object") & (F.size(strong) > 0))
    tags_ = F.coalesce("t", F.array().cast("array<string>"))
    status = F.when(F.col("target").isNull(), "no_target").when(maps, "mapped").when((F.col("slot") == "object") | (F.size(lex) > 0) | (F.size(tags_) > 0), "review").otherwise("literal")
    shown = F.coalesce(sure, weak)
    front = F.transform(F.array_except(tags_, iris(shown)), lambda c: F.concat(F.lit("tag:"), c))
    chosen = F.when(sure.isNotNull(), iris(sure)).when(maps, iris(strong)).otherwise(F.array().cast("array<string>"))
    return out.select(*KEY, "value", "article", "n", status.alias("status"), (F.col("target").isNotNull() & (sure.isNotNull() | (F.size(lex) > 0))).alias("lexical_hit"), chosen.alias("iri"), F.concat(front, F.transform(shown, lambda x: F.concat(x["method"], F.lit(":"), x["iri"]))).alias("candidates"))


def to_adjudicate(sheet: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of a worksheet that are to be reviewed, in a stable order."""
    out = sheet.where("status = 'review'").orderBy("slot", "regulation", F.desc("n"), "value", "article")
    return out if limit is None else out.limit(limit)
