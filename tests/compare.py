"""Rows of a Spark query against those of its DuckDB SQL, whatever their order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(frame, columns):
    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


def same(df, sql, c):
    got, want = df.toPandas(), c.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
