"""A corpus pipeline: quality rules, near duplicates, personal data, source mix, token ids.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the session's shared folder and read again as the next one's ``docs``, so a
lost executor costs at most the stage it worked on. ``run`` applies them to ``documents``.

Defined cases (see each operator's module): null and empty texts fail the quality rules; where they come in later they stay in near-dedup,
keep no span, are in no mix (they have no words) and have no ids. Rows with a null doc_id are kept by near-dedup uncompared. Of rows that
repeat doc_id and text one stays, rows that share a doc_id alone are documents of their own. All stages but the last return
the columns of their input, extra ones included, whatever their names; the last replaces columns that have the name of one it adds.
Ties are broken by hashes of the rows, so reruns agree. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import minhash, mixing, pieces, pii, quality
from gleaner.llm.common import fresh_dir, table
from gleaner.sources.tables import ship_package


def _stage(work):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return work(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", _stage(quality.stage)),
    ("MinHash near-dedup", _stage(minhash.stage)),
    ("PII", _stage(pii.stage)),
    ("mixing sources to target weights", _stage(mixing.stage)),
    ("SentencePiece encoding", _stage(pieces.stage)),
]

#: SQL cannot express the stages (trained models, sampled signatures, a tokenizer): they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        where = fresh_dir(spark, "stage")
        work(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
