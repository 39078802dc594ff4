"""Answers, files and indexes checked against what they should be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxed import boxed, evaluated
from ..functions.chunking import chunked
from ..sources import verified
from ..sources.tables import saved, table
from ..streaming.runs import _folder
from .registry import query

#: A turn's text written as an answer: plain, boxed, boxed twice with braces inside, not closed, and an empty box.
_ANSWERS = r"""t AS (SELECT conv_id, turn, text, regexp_extract_all(text, '([\p{L}\p{N}]+)', 1) AS w FROM conversations),
a AS (SELECT conv_id, turn, w, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN 'so \boxed{' || w[1] || ', ' || w[2] || '} ok' WHEN 2 THEN '\boxed{x} or \boxed{' || w[1] || ' {' || w[2] || '{}};' || w[3] || '}}' WHEN 3 THEN 'a \boxed{' || text ELSE text || ' \boxed{ }' END AS prediction FROM t WHERE len(w) > 3),
p AS (SELECT *, CASE WHEN contains(prediction, '\boxed{') THEN string_split(prediction, '\boxed{')[-1] END AS tail FROM a),
c AS (SELECT conv_id, turn, unnest(range(1, length(tail) + 1)) AS i, tail FROM p WHERE tail IS NOT NULL), d AS (SELECT conv_id, turn, i, 1 + sum(CASE tail[i] WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS depth FROM c),
e AS (SELECT conv_id, turn, min(i) AS i FROM d WHERE depth = 0 GROUP BY 1, 2),
b AS (SELECT conv_id, turn, w, prediction, coalesce(nullif(trim(tail[1:i - 1]), ''), trim(prediction)) AS answer FROM p LEFT JOIN e USING (conv_id, turn))"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    w = lambda i: F.element_at("w", i)
    k = F.col("turn") % 5
    said = (
        F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit(r"so \boxed{"), w(1), F.lit(", "), w(2), F.lit("} ok")))
        .when(k == 2, F.concat(F.lit(r"\boxed{x} or \boxed{"), w(1), F.lit(" {"), w(2), F.lit("{}};"), w(3), F.lit("}}"))).when(k == 3, F.concat(F.lit(r"a \boxed{"), "text")).otherwise(F.concat("text", F.lit(r" \boxed{ }")))
    )
    t = table(spark, d, "conversations").withColumn("w", F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1)).where("size(w) > 3")
    return t.select("conv_id", "turn", "w", said.alias("prediction"))


@query("boxed_answers", f"WITH {_ANSWERS} SELECT conv_id, turn, md5(answer) AS digest FROM b")
def boxed_answers(spark: SparkSession, d: str) -> DataFrame:
    """The last balanced box of every turn's answer."""
    return _answers(spark, d).select("conv_id", "turn", F.md5(boxed(F.col("prediction")).cast("binary")).alias("digest"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(x), '[‐‑‒–—―\p{P}\p{S}-]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))"
_SET = f"list_filter(list_transform(regexp_split_to_array(@, CASE WHEN contains(evaluator, 'separators') THEN '[;]' ELSE '[,;]' END), lambda x: {_NORM}), lambda x: x <> '')"


@query("answer_evaluation", rf"""WITH {_ANSWERS}, r AS (SELECT *, CASE (conv_id + turn) % 4 WHEN 0 THEN 'norm_phrase_set_match' WHEN 1 THEN 'norm_phrase_set_match_ordered|separators=;' WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN 'mc_choice_match' ELSE 'mc_choice_set_match' END ELSE CASE WHEN turn % 2 = 0 THEN 'llm_abstention_checker' ELSE 'llm_gotchas_checker|x' END END AS evaluator, CASE WHEN turn % 5 = 1 THEN w[2] || '; ' || lower(w[1]) WHEN turn % 5 = 2 THEN lower(w[1] || '-' || w[2]) || ';' || w[3] WHEN turn % 5 = 0 THEN prediction ELSE 'none of A or B' END AS reference FROM b),
x AS (SELECT *, {_SET.replace('@', 'answer')} AS ps, {_SET.replace('@', 'reference')} AS rs, regexp_extract_all(upper(answer), '\b([A-H])\b', 1) AS pc, regexp_extract_all(upper(reference), '\b([A-H])\b', 1) AS rc FROM r)
SELECT conv_id, turn, evaluator, CASE WHEN evaluator LIKE 'norm_phrase_set_match' THEN len(ps) > 0 AND list_sort(ps) = list_sort(rs) WHEN evaluator LIKE 'norm%' THEN len(ps) > 0 AND ps = rs WHEN evaluator = 'mc_choice_match' THEN len(pc) > 0 AND pc = rc WHEN evaluator = 'mc_choice_set_match' THEN len(pc) > 0 AND list_sort(pc) = list_sort(rc) END AS correct,
CASE WHEN evaluator LIKE 'llm_abs%' THEN 'abstention' WHEN evaluator LIKE 'llm_got%' THEN 'gotchas' END AS judge FROM x""")
def answer_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's answer judged by one of the evaluators against a reference made of its words."""
    even = F.col("turn") % 2 == 0
    k = (F.col("conv_id") + F.col("turn")) % 4
    by = F.when(k == 0, "norm_phrase_set_match").when(k == 1, "norm_phrase_set_match_ordered|separators=;").when(k == 2, F.when(even, "mc_choice_match").otherwise("mc_choice_set_match")).otherwise(F.when(even, "llm_abstention_checker").otherwise("llm_gotchas_checker|x"))
    w = lambda i: F.element_at("w", i)
    n = F.col("turn") % 5
    want = F.when(n == 1, F.concat(w(2), F.lit("; "), F.lower(w(1)))).when(n == 2, F.concat(F.lower(F.concat_ws("-", w(1), w(2))), F.lit(";"), w(3))).when(n == 0, F.col("prediction")).otherwise("none of A or B")
    return evaluated(_answers(spark, d).withColumn("evaluator", by).withColumn("reference", want)).select("conv_id", "turn", "evaluator", "correct", "judge")


@query("verified_files", """SELECT n_nationkey::BIGINT AS nation, octet_length(encode(n_name)) + 1 AS bytes, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE sha256(n_name || chr(10)) END AS sha256, CASE WHEN n_nationkey % 7 = 3 THEN 'missing' WHEN n_nationkey % 5 = 0 THEN 'mismatch' ELSE 'verified' END AS outcome FROM nation""")
def verified_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each nation, read as bytes and compared with the sizes and digests on record; some records are wrong, some files absent."""
    where = f"{_folder(spark)}-files"
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("value"))
    n.where("nation % 7 <> 3").write.partitionBy("nation").text(where)
    found = verified.inspected(spark, f"{where}/nation=*").withColumn("nation", F.regexp_extract("path", r"nation=(\d+)/", 1).cast("long"))
    text = F.concat("value", F.lit("\n"))
    expected = n.select("nation", F.octet_length(text).cast("long").alias("bytes"), F.sha2(F.when(F.col("nation") % 5 == 0, "other").otherwise(text), 256).alias("sha256"))
    out = verified.verified(found, expected, "nation")
    return expected.select("nation", "bytes").join(found.select("nation", "sha256"), "nation", "left").join(out, "nation")


@query("index_validation", """SELECT doc_id AS id, CASE WHEN doc_id % 11 = 1 THEN 'incomplete' WHEN doc_id % 11 IN (2, 3) THEN 'chunk' ELSE 'exact' END AS outcome, CASE WHEN doc_id % 11 IN (2, 3) THEN 0 END::INT AS ordinal FROM documents WHERE text <> ''""")
def index_validation(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks of all memories before they are used again: some lack their last, some differ in their first, some have vectors of another revision."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    expected = saved(chunked(docs).select("id", "ordinal", "chunk"))
    last = expected.groupBy("id").agg(F.max("ordinal").alias("last"))
    k = F.col("id") % 11
    stored = expected.join(last, "id").where((k != 1) | (F.col("ordinal") < F.col("last")))
    stored = stored.select("id", "ordinal", F.when((k == 2) & (F.col("ordinal") == 0), F.concat("chunk", F.lit("!"))).otherwise(F.col("chunk")).alias("chunk"), F.when((k == 3) & (F.col("ordinal") == 0), "old").otherwise("new").alias("revision"))
    return verified.index_outcomes(expected, stored, "new")
