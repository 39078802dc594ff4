"""Set-returning functions called from SQL: job claims with their chunks, and the report of embedding generations.

Every memory has an embedding job in the lane of its workspace; two generations of vectors are derived from the documents: the
second lacks every seventh memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import table_functions
from ..sources.tables import table
from .registry import query

#: A job's state by its memory's id; times in microseconds, a minute from one job to the next.
_JOBS = """SELECT doc_id % 5 AS lane, doc_id * 10 + 1 AS job_id, doc_id AS memory_id, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'dead' END AS status, CAST(doc_id % 6 AS INT) AS attempt,
CAST((doc_id * 7919) % 1009 AS BIGINT) * 60000000 AS ready_us, CAST((doc_id * 104729) % 1013 AS BIGINT) * 60000000 AS leased_us FROM documents"""
_NOW, _LEASE, _MOST, _ATTEMPTS = 500 * 60_000_000, 15 * 60_000_000, 25, 5


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    """``text`` over the documents as a view, with the set-returning functions known."""
    table_functions.register(spark)
    return spark.sql(text, docs=table(spark, d, "documents"))


@query("claimed_job_chunks", f"""WITH jobs AS ({_JOBS}), c AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY ready_us, job_id) AS k FROM jobs WHERE attempt < {_ATTEMPTS} AND ((status = 'pending' AND ready_us <= {_NOW}) OR (status = 'processing' AND leased_us <= {_NOW - _LEASE})))
SELECT lane, job_id, memory_id, (attempt + 1)::INT AS attempt, length(text) AS chars, md5(text) AS digest FROM c JOIN documents ON doc_id = memory_id WHERE k <= {_MOST} AND text <> ''""")
def claimed_job_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The jobs that a worker of each lane may claim, with their memories' chunks; the chunks make up the whole text."""
    return _sql(spark, d, f"""
        WITH claimed AS (SELECT * FROM claim_jobs(TABLE({_JOBS.replace("FROM documents", "FROM {docs}")}) PARTITION BY lane ORDER BY (ready_us, job_id), {_MOST}, {_NOW}L, {_LEASE}L, {_ATTEMPTS}))
        SELECT lane, job_id, memory_id, attempt, CAST(sum(length(chunk)) AS BIGINT) AS chars, md5(array_join(transform(array_sort(collect_list(struct(ordinal, chunk))), c -> c.chunk), '')) AS digest
        FROM claimed JOIN {{docs}} ON doc_id = memory_id, LATERAL memory_chunks(text)
        GROUP BY lane, job_id, memory_id, attempt""")


_KINDS = """SELECT g AS generation_id, 'chunk' AS kind, count(*) AS n FROM documents CROSS JOIN {two} GROUP BY 1
UNION ALL SELECT g, 'embedded', count(*) FROM documents CROSS JOIN {two} WHERE g = 1 OR doc_id % 7 <> 0 GROUP BY 1
UNION ALL SELECT g, CASE WHEN doc_id % 3 = 0 THEN 'pending' WHEN doc_id % 3 = 1 THEN 'processing' ELSE 'dead' END, count(*) FROM documents CROSS JOIN {two} WHERE g = 2 AND doc_id % 7 = 0 GROUP BY 1, 2"""


@query("generation_report", f"""WITH k AS ({_KINDS.format(two='(VALUES (1), (2)) AS t(g)')}), s AS (SELECT generation_id::BIGINT AS generation_id, coalesce(sum(n) FILTER (kind = 'chunk'), 0)::BIGINT AS eligible, coalesce(sum(n) FILTER (kind = 'embedded'), 0)::BIGINT AS embedded, coalesce(sum(n) FILTER (kind IN ('pending', 'processing')), 0)::BIGINT AS pending, coalesce(sum(n) FILTER (kind = 'dead'), 0)::BIGINT AS dead FROM k GROUP BY 1)
SELECT generation_id, eligible, embedded, eligible - embedded AS missing, pending, dead FROM s""")
def generation_report(spark: SparkSession, d: str) -> DataFrame:
    """What each generation of vectors has and lacks; the table that the function reads holds counts."""
    counts = _KINDS.format(two="(VALUES (1), (2)) AS t(g)").replace("FROM documents", "FROM {docs}").replace("SELECT g AS", "SELECT CAST(g AS BIGINT) AS", 1)
    return _sql(spark, d, f"SELECT * FROM generation_report(TABLE({counts}) PARTITION BY generation_id)")
