"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, langid, language_model, minhash, mixing, quality, repetition, shared, simhash, suffix_dedup, toxicity, warc, whitening
from .sampling import fold


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _predicted(out: DataFrame, held) -> DataFrame:
    return out.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 3) == 1
    out = quality.score_quality(_docs(spark, sf_dir), _labels(spark, sf_dir), ~held)
    return _predicted(out, held).select("doc_id", "held_out", "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 5) == 0
    out = toxicity.score_toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir), ~held)
    return _predicted(out, held).select("doc_id", "held_out", "score", "predicted", "spans")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = fold("doc_id", 3) == 1
    out = langid.identify_languages(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_rules(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    to = shared.fresh(spark, "warc")
    back = warc.read_records(warc.write_archives(pages, to), to, payloads=False)
    kind = pages.schema["page_id"].dataType
    back = back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
    out = shared.cut(back)
    shared.remove(spark, to)
    return out


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = fold("doc_id", 10) == 0
    out = language_model.score_texts(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_docs(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_docs(spark, sf_dir))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.reports(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (
  SELECT doc_id, n, i, ws[i : i + n - 1] AS gram, ws
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM t, (VALUES (5), (6), (7), (8), (9), (10)) AS sizes(n) WHERE len(ws) >= n)),
r AS (SELECT doc_id, n, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, n, gram) > 1),
covered AS (SELECT DISTINCT doc_id, n, i + j AS i FROM (SELECT doc_id, n, i, unnest(range(0, n)) AS j FROM r)),
share AS (
  SELECT c.doc_id, c.n, count(*) AS n_in, sum(length(t.ws[c.i])) AS chars_in
  FROM covered c JOIN t USING (doc_id) GROUP BY ALL),
lines AS (
  SELECT doc_id, line, count(*) AS copies
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (
  SELECT doc_id, sum(copies - 1) AS n_dup_lines,
         sum((copies - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS dup_chars
  FROM lines GROUP BY ALL),
base AS (
  SELECT t.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup_chars, 0) AS dup_chars,
    coalesce((SELECT n_in FROM share s WHERE s.doc_id = t.doc_id AND s.n = 5), 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN dup USING (doc_id)),
bad AS (
  SELECT DISTINCT s.doc_id FROM share s JOIN base b USING (doc_id)
  JOIN (VALUES (5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10)) AS most(n, share) ON s.n = most.n
  WHERE s.chars_in::DOUBLE / greatest(b.word_chars, 1) > most.share::DOUBLE)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND dup_chars::DOUBLE / greatest(word_chars, 1) <= 0.2::DOUBLE
    AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM base
"""

_OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (k // 4)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM r
"""

def _least(*paths: str) -> str:
    """The first of the paths, by cost and audit, that there are."""
    return f"list_sort(list_filter([{', '.join(paths)}], lambda p: p IS NOT NULL))[1]"


def _go(path: str, cost: str, letter: str, said: str = "''", when: str = "TRUE") -> str:
    return f"CASE WHEN {path} IS NOT NULL AND {when} THEN {{'c': ({path}.c + {cost})::BIGINT, 'a': {path}.a || '{letter}', 'o': {path}.o || {said}}} END"


def _row(state: int) -> str:
    """The paths into a state by one row r: deleted, kept or given another role."""
    into = {0: [], 1: [(0, "s", None)], 2: [(0, "u", "user"), (1, "u", "user"), (3, "u", "user")], 3: [(2, "a", "assistant")]}
    paths = [_go(f"s{state}", "2", "D")]
    for before, initial, role in into[state]:
        paths.append(_go(f"s{before}", "r.stays", "K", "chr(10) || r.role || ':' || r.text", f"NOT r.must_go AND left(r.role, 1) = '{initial}'"))
        if role:
            paths.append(_go(f"s{before}", "1 + r.stays", "R", f"chr(10) || '{role}:' || r.text", "NOT r.must_go"))
    return _least(*paths)


def _inserted() -> str:
    user = [_go(f"s{k}", "5", "I", "chr(10) || 'user:'") for k in (0, 1, 3)]
    return f"s0, s1, {_least('s2', *user)} AS s2, {_least('s3', _go('s2', '5', 'I', "chr(10) || 'assistant:'"))} AS s3"


_NONE = "NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
_OP11_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, t),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE kind <> 0),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM damaged),
r AS (
  SELECT conv_id, i, turn, role, text, last = '' AS blank, last <> '' AND seen AS again,
    last <> '' AND NOT seen AND last NOT IN ('.', '!', '?') AS cut,
    last = '' OR seen AS must_go, CASE WHEN last NOT IN ('', '.', '!', '?') THEN 5 ELSE 0 END AS stays,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM marked),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count_if(blank)::BIGINT AS blank, count_if(again)::BIGINT AS duplicate, count_if(cut)::BIGINT AS truncated,
    count_if(before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM r GROUP BY conv_id),
path AS (
  SELECT conv_id, 0::BIGINT AS i, {_inserted()} FROM (
    SELECT conv_id, i, {_inserted()} FROM (
      SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3
      FROM (SELECT DISTINCT conv_id FROM conversations)))
  UNION ALL
  SELECT conv_id, i, {_inserted()} FROM (
    SELECT conv_id, i, {_inserted()} FROM (
      SELECT p.conv_id, p.i + 1 AS i, {_row(0)} AS s0, {_row(1)} AS s1, {_row(2)} AS s2, {_row(3)} AS s3
      FROM path p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
best AS (
  SELECT p.conv_id, c.n, gaps, blank, duplicate, truncated, illegal, {_least('s0', 's3')} AS best
  FROM path p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(c.n, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.o, 2)) AS repaired_sha256
FROM best
"""

_OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS gram FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 10 * na.n >= 8 * nb.n AND 10 * nb.n >= 8 * na.n
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS root FROM n
  UNION
  SELECT e.v, r.root FROM reach r JOIN (SELECT u, v FROM link UNION ALL SELECT v, u FROM link) e ON e.u = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

QUERIES = {"op1_quality": op1_quality, "op2_toxicity": op2_toxicity, "op3_language": op3_language, "op4_repetition": op4_repetition, "op5_warc": op5_warc, "op6_simhash": op6_simhash, "op7_decontaminate": op7_decontaminate, "op8_lm": op8_lm, "op9_suffix": op9_suffix, "op10_mixing": op10_mixing, "op11_repair": op11_repair, "op12_minhash": op12_minhash, "op13_whitening": op13_whitening}
ORACLE_SQL = {"op5_warc": _OP5_SQL, "op4_repetition": _OP4_SQL, "op11_repair": _OP11_SQL, "op12_minhash": _OP12_SQL}
