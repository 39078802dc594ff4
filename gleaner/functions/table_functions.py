"""Set-returning functions for SQL: job claims, generation reports, and the chunks of a text.

``register`` makes them known to a session by name. The first two take a table, dealt by PARTITION BY and put in order by ORDER BY;
the last one is called by LATERAL.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import SkipRestOfInputTableException

from .chunking import chunks


@udtf(returnType="lane bigint, job_id bigint, memory_id bigint, attempt int")
class ClaimJobs:
    """The first jobs of each lane that may be claimed, in the lane's order, ``most`` a lane.

    A job (lane, job_id, memory_id, status, attempt, ready_us, leased_us) may be claimed with attempts left if it is pending and ready, or if
    its lease has run out. Nothing of a lane is read after its last claim.
    """

    def __init__(self) -> None:
        self.claimed = 0

    def eval(self, job: Row, most: int, now_us: int, lease_us: int, max_attempts: int) -> Iterator[tuple]:
        if self.claimed >= most:
            raise SkipRestOfInputTableException("the lane has its claims")
        ready = job["status"] == "pending" and job["ready_us"] <= now_us
        lapsed = job["status"] == "processing" and job["leased_us"] <= now_us - lease_us
        if job["attempt"] < max_attempts and (ready or lapsed):
            self.claimed += 1
            yield job["lane"], job["job_id"], job["memory_id"], job["attempt"] + 1


@udtf(returnType="generation_id bigint, eligible bigint, embedded bigint, missing bigint, pending bigint, dead bigint")
class GenerationReport:
    """One row a generation from its counts (generation_id, kind, n): chunks, embedded, pending, processing and dead.

    The counts come from an aggregation, so a generation's rows are as many as there are kinds.
    """

    def __init__(self) -> None:
        self.generation, self.n = None, {}

    def eval(self, counted: Row) -> None:
        self.generation = counted["generation_id"]
        self.n[counted["kind"]] = self.n.get(counted["kind"], 0) + counted["n"]

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            n = lambda k: self.n.get(k, 0)
            yield self.generation, n("chunk"), n("embedded"), n("chunk") - n("embedded"), n("pending") + n("processing"), n("dead")


@udtf(returnType="ordinal int, chunk string")
class MemoryChunks:
    """The chunks of a text in order; none of an empty or null one."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(chunks(text))


def register(spark: SparkSession) -> None:
    for name, f in (("claim_jobs", ClaimJobs), ("generation_report", GenerationReport), ("memory_chunks", MemoryChunks)):
        spark.udtf.register(name, f)
