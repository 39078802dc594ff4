"""Greedy diversification (maximal marginal relevance): sequential within a query's few results."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

_term = re.compile(r"[^\W_][\w'-]*")


def diversified(hits: DataFrame, limit: int, balance: float) -> DataFrame:
    """(query_id, id, position) of each query's results (query_id, id, rank, evidence), greedily chosen.

    Each step takes the result with the highest balance * relevance - (1 - balance) * largest Jaccard similarity
    of its terms with those chosen before; relevance falls linearly with the rank. Results are as many as a query's ranking holds
    (rankings are cut before), so a group is small.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        n = len(pdf)
        words = [{w for w in _term.findall((t or "").lower()) if len(w) > 1} for t in pdf["evidence"]]
        near = [0.0] * n
        left, chosen = list(range(n)), []
        while left and len(chosen) < limit:
            best = max(left, key=lambda i: (balance * (n - i) / n - (1 - balance) * near[i], -i))
            left.remove(best)
            chosen.append(best)
            for i in left:
                either = len(words[i] | words[best])
                near[i] = max(near[i], len(words[i] & words[best]) / either if either else 1.0)
        return pd.DataFrame({"query_id": pdf["query_id"][chosen], "id": pdf["id"][chosen], "position": range(1, len(chosen) + 1)})

    return hits.select("query_id", "id", "rank", "evidence").groupBy("query_id").applyInPandas(choose, "query_id long, id long, position int")
