"""The operators as stages over documents: each takes documents and returns those that stay, changed where that is its work.

Defined cases of all stages: null and empty texts are documents like others, without words: they are not toxic, all near
copies of each other, have nothing to cut and meet no benchmark. Repeated rows and equal or null doc_ids are each
judged by themselves, and of equal ones near_duplicates keeps one. Long texts are read whole, as the operators state. An
empty table gives no rows. Columns other than those of documents are left out, whatever their names. Inputs
must be tables or checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, mixing, near_copies, suffix_dedup, toxicity
from .sampling import fold

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents scored under 0.5; the labels of documents whose crc32 modulo 5 is not 0 teach."""
    return toxicity.score_toxicity(docs, labels, fold("doc_id", 5) != 0, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates, linked by a Jaccard of 0.8 or more over five-word shingles, the row with the smallest doc_id."""
    return near_copies.one_of_each(docs.select(*COLUMNS))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """All documents without the bytes of their repeated passages."""
    out = suffix_dedup.deduplicate(docs, keep=COLUMNS, text=True)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that no benchmark item overlaps."""
    return decontaminate.clean(docs.select(*COLUMNS), benchmark)


def sample_mixture(docs: DataFrame) -> DataFrame:
    """The documents drawn for the target mixture, with their weight and probability."""
    return mixing.mix_documents(docs, keep_columns=COLUMNS).where("sampled").select(*COLUMNS, "weight", "probability")
