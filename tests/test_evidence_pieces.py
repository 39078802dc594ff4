"""Evidence windows: texts are not cut into pieces twice."""

import re

from gleaner.plans import retrieval


def test_only_documents_of_hits_are_cut_again(spark, sf):
    plan = retrieval.evidence_windows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow", plan)) == 1 and "LeftSemi" in plan
