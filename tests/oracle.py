"""Compares a query with its DuckDB equivalent: names, row count and values, order aside."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = pd.to_datetime(out[c]).dt.tz_localize(None).astype("datetime64[us]").astype(str)
        elif out[c].dtype.kind in "iub":
            out[c] = out[c].astype("int64").astype(str)
        elif out[c].dtype.kind == "f":
            out[c] = out[c].map(lambda v: "null" if pd.isna(v) else f"{v:.6g}")
        else:
            out[c] = out[c].map(lambda v: "null" if v is None or v is pd.NaT or v != v else str(v).replace("T", " "))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(spark_df, con, sql):
    mine, theirs = normal(spark_df.toPandas()), normal(con.execute(sql).df())
    assert list(mine.columns) == list(theirs.columns), (list(mine.columns), list(theirs.columns))
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    wrong = (mine != theirs).any(axis=1)
    assert not wrong.any(), (int(wrong.sum()), mine[wrong].head(3).to_dict("records"), theirs[wrong].head(3).to_dict("records"))
    return len(mine)
