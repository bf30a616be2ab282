"""Run catalogue queries next to their SQL in DuckDB and compare whole results.

As a script: ``python tests/oracle_compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True) if len(frame) else frame.reset_index(drop=True)


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None if equal (columns, kinds, rows, values to the last bit), else the first difference."""
    a, b = normal(spark_frame), normal(sql_frame)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} / {list(b.columns)}"
    kinds = [(c, str(a[c].dtype), str(b[c].dtype)) for c in a.columns if a[c].dtype != b[c].dtype]
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for c in a.columns:
        different = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if different.any():
            at = different.idxmax()
            return f"{int(different.sum())} values of {c}, first {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
    return f"types {kinds}" if kinds else None


def main() -> None:
    from shelfsense.plans.catalogue import QUERIES
    from shelfsense.plans.oracles import ORACLES
    from shelfsense.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        try:
            begin = time.time()
            result = QUERIES[name](spark, sf_dir).toPandas()
            spark_time, begin = time.time() - begin, time.time()
            if name not in ORACLES:
                print(f"{name:26} rows only {len(result):8} {spark_time:6.1f}s", flush=True)
                continue
            wrong = compare(result, con.execute(ORACLES[name]).df())
            print(f"{name:26} {wrong or 'equal'} {len(result):8} {spark_time:6.1f}s sql {time.time() - begin:5.1f}s", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{name:26} FAILED {type(error).__name__}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
