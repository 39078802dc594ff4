import importlib.util

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


def test_stages_take_effect(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, work in P.STAGES[:4]:
        docs = work(spark, docs, sf)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[2]
    last = P.STAGES[4][1](spark, docs, sf)
    assert last.count() == seen[4] and last.where("not restored").count() == 0
