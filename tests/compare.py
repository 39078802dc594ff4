"""Order-insensitive comparison of a Spark result with an independent engine's."""

import duckdb
import pandas as pd

from gleaner.sources.tables import TABLES


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "∅" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else repr(round(float(v), 8)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)
