"""Scoring against gold data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import storage


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    return ratio((1 + beta**2) * p * r, beta**2 * p + r)


def confusion(rows: DataFrame, gold: str, system: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(system).alias("system")).agg(F.count("*").alias("n"))


def per_label(matrix: DataFrame, labels: list) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 and f2 of each label, 0 where nothing is counted."""
    dim = matrix.sparkSession.createDataFrame([(x,) for x in labels], "label int" if isinstance(labels[0], int) else "label string")
    is_gold, is_system = F.col("gold") == F.col("label"), F.col("system") == F.col("label")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    counts = matrix.join(F.broadcast(dim), F.lit(True)).groupBy("label").agg(n(is_gold & is_system).alias("tp"), n(~is_gold & is_system).alias("fp"), n(is_gold & ~is_system).alias("fn"))
    counts = dim.join(counts, "label", "left").select("label", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("label", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f_beta(p, r, 1), 6).alias("f1"), F.round(f_beta(p, r, 2), 6).alias("f2"))


def macro_f1(scores: DataFrame) -> DataFrame:
    """The mean F1 over the labels of per_label; labels that never occur count as 0."""
    return scores.agg(F.count("*").alias("labels"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def resolve_paraphrases(results: DataFrame, paraphrases: DataFrame, gold: DataFrame) -> DataFrame:
    """Results (query_id and more) with base_id and the gold row of that: a paraphrase has its base's."""
    to = paraphrases.select(F.col("query_id"), F.col("paraphrase_of"))
    out = results.join(to, "query_id", "left").withColumn("base_id", F.coalesce("paraphrase_of", F.col("query_id").cast(paraphrases.schema["paraphrase_of"].dataType))).drop("paraphrase_of")
    return out.join(gold.withColumnRenamed("query_id", "base_id"), "base_id")


def _citation_sums(g: Column, s: Column, rows: DataFrame) -> DataFrame:
    both = F.size(F.array_intersect(g, s))
    sums = rows.agg(F.coalesce(F.sum(both), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.size(s) - both), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.size(g) - both), F.lit(0)).alias("fn"))
    return sums.select("tp", "fp", "fn", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))


def citation_scores(rows: DataFrame) -> DataFrame:
    """Micro precision and recall of the arrays gold and cited; rows without gold are left out."""
    return _citation_sums(F.array_distinct("gold"), F.array_distinct("cited"), rows.where("size(gold) > 0"))


def provision(citation: Column) -> Column:
    """A citation without the number of its statement."""
    return F.regexp_replace(citation, r"#s\d+$", "")


def provision_scores(rows: DataFrame) -> DataFrame:
    """Micro precision and recall of the provisions of gold and cited; rows without gold count."""
    bare = lambda c: F.array_distinct(F.transform(c, provision))
    return _citation_sums(bare("gold"), bare("cited"), rows)


def citation_errors(rows: DataFrame) -> DataFrame:
    """The rows with the provisions that are cited without being gold, and the gold ones that aren't cited."""
    bare = lambda c: F.array_distinct(F.transform(c, provision))
    return rows.withColumns({"spurious": F.array_sort(F.array_except(bare("cited"), bare("gold"))), "missed": F.array_sort(F.array_except(bare("gold"), bare("cited")))})


def tightened(cited: Column, explanation: Column) -> Column:
    """The citations that the explanation names, conflicts left out."""
    return F.filter(cited, lambda c: F.contains(explanation, c) & ~F.contains(c, F.lit("CONFLICTS")))


def consistency(rows: DataFrame) -> DataFrame:
    """Over bases asked more than once: how many, how many with one verdict throughout, and the spread of adherence."""
    per = rows.groupBy("base").agg(F.count("*").alias("asked"), F.countDistinct("verdict").alias("verdicts"), F.avg(F.col("adheres").cast("double")).alias("adherence")).where("asked > 1")
    return per.agg(F.count("*").alias("bases"), F.count_if(F.col("verdicts") == 1).alias("consistent"), F.round(F.max("adherence") - F.min("adherence"), 6).alias("spread"))


def subset_adherence(rows: DataFrame) -> DataFrame:
    """subset, asked and agreed by subset of paraphrases, and the range of their rates."""
    per = rows.groupBy("subset").agg(F.count("*").alias("asked"), F.count_if("adheres").alias("agreed"))
    rate = ratio(F.col("agreed"), F.col("asked"))
    ends = per.agg(F.round(F.max(rate) - F.min(rate), 6).alias("spread"))
    return per.join(F.broadcast(ends), F.lit(True)).select("subset", "asked", "agreed", "spread")


def by_confidence(rows: DataFrame, buckets: list[tuple[str, float | None]]) -> DataFrame:
    """Rows and agreements by bucket of confidence; a bucket ends before its bound."""
    bucket = F.lit(buckets[-1][0])
    for name, bound in reversed(buckets[:-1]):
        bucket = F.when(F.col("confidence") < bound, name).otherwise(bucket)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("agrees").alias("agree"))


def stability(rows: DataFrame, runs: int) -> DataFrame:
    """Slots, those present in at least so many runs, and those of two or more runs with more than one value."""
    per = rows.groupBy("slot").agg(F.count("*").alias("runs"), F.countDistinct("value").alias("forms"))
    return per.agg(F.count("*").alias("slots"), F.count_if(F.col("runs") >= runs).alias("present"), F.count_if((F.col("runs") >= 2) & (F.col("forms") > 1)).alias("wobbling"))


def wobble(rows: DataFrame) -> DataFrame:
    """field, slots seen in two or more runs, and those of them with more than one value. rows: slot, run, field and value."""
    value = F.coalesce("value", F.lit(""))
    # more than one is told by the ends, for which no distinct values are held
    per = rows.groupBy("slot", "field").agg((F.min("run") < F.max("run")).alias("again"), (F.min(value) < F.max(value)).alias("wobbles")).where("again")
    return per.groupBy("field").agg(F.count("*").alias("slots"), F.count_if("wobbles").alias("wobbling"))


def drift(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """field, compared, drifted, rate, excess over the baseline's wobble and whether it is beyond that. rows: field, before and after; baseline: of :func:`wobble`."""
    same = F.coalesce("before", F.lit("")) == F.coalesce("after", F.lit(""))
    per = rows.groupBy("field").agg(F.count("*").alias("compared"), F.count_if(~same).alias("drifted"))
    base = baseline.select("field", ratio(F.col("wobbling"), F.col("slots")).alias("base"))
    out = per.join(base, "field", "left").withColumn("rate", ratio(F.col("drifted"), F.col("compared")))
    excess = F.col("rate") - F.coalesce("base", F.lit(0.0))
    return out.select("field", "compared", "drifted", F.round("rate", 6).alias("rate"), F.round(excess, 6).alias("excess"), (excess > 1e-9).alias("drifts"))


def completeness(expected: DataFrame, found: DataFrame) -> DataFrame:
    """id and problem: missing where it isn't found, extra where it isn't expected, empty where it has no answer."""
    n = storage.parts(expected.sparkSession, expected.count() + found.count())
    expected, found = expected.select("id").repartition(n, "id"), found.repartition(n, "id")
    missing = expected.join(found, "id", "left_anti").withColumn("problem", F.lit("missing"))
    out = missing.unionByName(found.select("id").join(expected, "id", "left_anti").distinct().withColumn("problem", F.lit("extra")))
    if "answer" in found.columns:
        blank = found.where(F.trim(F.coalesce("answer", F.lit(""))) == "").select("id").distinct()
        out = out.unionByName(blank.withColumn("problem", F.lit("empty")))
    return out


def latest_in_order(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row of each key with first_seen, where the key came first, by which to order them."""
    others = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max(F.struct(sequence, *(c for c in others if c != sequence))).alias("row"), F.min(sequence).alias("first_seen"))
    return top.select(key, *(F.col(f"row.{c}").alias(c) for c in others), "first_seen")


def loop_statistics(results: DataFrame) -> DataFrame:
    """kind, label and n: answers by how their seeds were found, attempts at a query by number and outcome, answers with attempts.

    results: seed_path and attempts, an array of struct(attempt, error).
    """
    paths = results.groupBy(F.col("seed_path").alias("label")).agg(F.count("*").alias("n")).select(F.lit("seed_path").alias("kind"), "label", "n")
    each = results.select(F.explode("attempts").alias("a")).select(F.concat_ws(":", F.col("a.attempt").cast("string"), F.when(F.col("a.error").isNull(), "ok").otherwise("error")).alias("label"))
    tries = each.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("attempt").alias("kind"), "label", "n")
    tried = results.agg(F.count_if(F.size("attempts") > 0).alias("n")).select(F.lit("with_attempts").alias("kind"), F.lit("").alias("label"), "n")
    return paths.union(tries).union(tried)


def validity(records: DataFrame) -> DataFrame:
    """class, n and the rates of records that were valid at the first attempt, are valid now, and are complete. records: class, attempts, valid and blank."""
    flag = lambda c: F.round(ratio(F.count_if(c), F.count("*")), 6)
    per = records.groupingSets([["class"], []], "class").agg(F.count("*").alias("n"), flag((F.col("attempts") == 1) & F.col("valid")).alias("first_attempt"), flag(F.col("valid")).alias("revalidated"), flag(~F.col("blank")).alias("complete"))
    return per.select(F.coalesce("class", F.lit("all")).alias("class"), "n", "first_attempt", "revalidated", "complete")


def detector_scores(rows: DataFrame) -> DataFrame:
    """check_name, class, tp, fp, fn, precision and recall of detectors, from rows of check_name, verdict and label; rows without a label are left out, and the class none too. A rate of nothing is null."""
    labelled = rows.where("label is not null and label <> ''")
    ends = labelled.select("check_name", F.explode(F.array_distinct(F.array("verdict", "label"))).alias("class"), "verdict", "label").where("class <> 'none'")
    n = lambda v, l: F.count_if((F.col("verdict") == F.col("class") if v else F.col("verdict") != F.col("class")) & (F.col("label") == F.col("class") if l else F.col("label") != F.col("class")))
    per = ends.groupBy("check_name", "class").agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"))
    return per.select("check_name", "class", "tp", "fp", "fn", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp"), None), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn"), None), 6).alias("recall"))


def judged_predictions(predictions: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """outcome and n over the gold rows: scored (agrees or differs), skipped where the prediction isn't adjudicated, missing where there is none.

    predictions: key, iri and adjudicated; gold: key and iri (arrays).
    """
    met = gold.select(*key, F.array_sort(F.array_distinct("iri")).alias("want")).join(predictions.select(*key, F.array_sort(F.array_distinct("iri")).alias("got"), "adjudicated"), key, "left")
    outcome = F.when(F.col("adjudicated").isNull(), "missing").when(~F.col("adjudicated"), "skipped").when(F.col("want") == F.col("got"), "agrees").otherwise("differs")
    return met.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def live_means(judged: DataFrame) -> DataFrame:
    """answers, mean and least faithfulness (supported of all claims, 1 without claims), and mean relevance. judged: supported, claims and similarities (array)."""
    faith = ratio(F.col("supported"), F.col("claims"), 1.0)
    mean = lambda a: ratio(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    return judged.agg(F.count("*").alias("answers"), F.round(F.avg(faith), 6).alias("faithfulness"), F.round(F.min(faith), 6).alias("least_faithful"), F.round(F.avg(mean(F.col("similarities"))), 6).alias("relevance"))


def worksheet(rows: DataFrame) -> DataFrame:
    """slot, regulation, value, article, n, paragraphs and place of each different value, the most frequent first and of those the first seen.

    rows: slot, regulation, value, article, iri and sequence.
    """
    key = ["slot", "regulation", "value", "article"]
    per = rows.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("iri")).alias("paragraphs"), F.min("sequence").alias("first_seen"))
    place = F.row_number().over(Window.partitionBy("slot", "regulation").orderBy(F.desc("n"), "first_seen"))
    return per.select(*key, "n", "paragraphs", place.alias("place"))


def grounding(values: DataFrame, sources: DataFrame) -> DataFrame:
    """The values (id, field, value) with missing: their words, in order, whose lemma is in no word of the source (id, text).

    """
    from tessella.operators import candidates

    lemmas = lambda c: F.array_distinct(F.transform(candidates.words(c), candidates.noun))
    out = values.join(sources.select("id", lemmas(F.col("text")).alias("known")), "id", "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    missing = F.filter(F.array_distinct(candidates.words(F.col("value"))), lambda w: ~w.isin(*candidates.STOP) & ~F.array_contains(known, candidates.noun(w)))
    return out.select(*values.columns, missing.alias("missing"))


def grounding_counts(flags: DataFrame) -> DataFrame:
    """field, id, value and the number of runs in which words of the value are missing from its source."""
    return flags.where("size(missing) > 0").groupBy("field", "id", "value").agg(F.countDistinct("run").alias("runs"))


def buckets(rows: DataFrame) -> DataFrame:
    """run, class ('all' for all) and how many are clean, hard, missed and extra. rows: run, class and bucket."""
    n = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    per = rows.groupingSets([["run", "class"], ["run"]], "run", "class").agg(*(n(b) for b in ("clean", "hard", "miss", "extra")))
    return per.select("run", F.coalesce("class", F.lit("all")).alias("class"), "clean", "hard", "miss", "extra")


def lenient_scores(counts: DataFrame) -> DataFrame:
    """The buckets with precision, recall, F1 and F2, where a hard mismatch costs precision but no recall."""
    p = ratio(F.col("clean"), F.col("clean") + F.col("hard") + F.col("extra"))
    r = ratio(F.col("clean"), F.col("clean") + F.col("miss"))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f_beta(p, r, 1), 6).alias("f1"), F.round(f_beta(p, r, 2), 6).alias("f2"))


def over_runs(scores: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The mean, least and largest of each column over the runs of a key."""
    return scores.groupBy(key).agg(*(f(c).alias(f"{c}_{name}") for c in columns for f, name in ((lambda x: F.round(F.avg(x), 6), "mean"), (F.min, "min"), (F.max, "max"))))


def pooled(counts: DataFrame) -> DataFrame:
    """Buckets of several evaluation sets added up by run and class before any rate is taken."""
    return counts.groupBy("run", "class").agg(*(F.sum(b).alias(b) for b in ("clean", "hard", "miss", "extra")))


def replay_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and change of groups (id, v) that differ: in their number of rows, or else as multisets."""
    side = lambda d, n: d.groupBy("id").agg(F.array_sort(F.collect_list("v")).alias(n))
    both = side(before, "x").join(side(after, "y"), "id", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("id", F.when(F.size("x").eqNullSafe(F.size("y")), "content").otherwise("count").alias("change"))
