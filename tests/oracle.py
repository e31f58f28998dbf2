"""A query's rows and its SQL's rows, in one comparable form."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(repr(x.tolist() if hasattr(x, "tolist") else x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def compare(spark, sf_dir: str, query, sql: str) -> None:
    ours = query(spark, sf_dir).toArrow().to_pandas(types_mapper=pd.ArrowDtype)
    theirs = connect(sf_dir).sql(sql).to_arrow_table().to_pandas(types_mapper=pd.ArrowDtype)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert {c: str(t) for c, t in ours.dtypes.items() if "decimal" not in str(t)} == {c: str(t) for c, t in theirs.dtypes.items() if "decimal" not in str(t)}
    assert rows_of(ours) == rows_of(theirs)
