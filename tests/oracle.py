"""Run registered queries against their check SQL: ``python -m tests.oracle [name or @module ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str = FOLDER):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        values = frame[column]
        if values.dtype.kind == "f":
            frame[column] = [("nan" if np.isnan(v) else repr(float(v))) for v in values]
        elif values.dtype.kind in "iu":
            frame[column] = values.astype("int64").astype(str)
        elif values.dtype.kind == "M":
            frame[column] = values.astype("datetime64[us]").astype(str)
        else:
            frame[column] = [_text(v) for v in values]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def _text(value) -> str:
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(_text(v) for v in value) + "]"
    if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return "nan"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (float, np.floating)):
        return repr(float(value))
    return str(value)


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    kinds = {c: (left[c].dtype, right[c].dtype) for c in left.columns if left[c].dtype.kind != right[c].dtype.kind}
    a, b = normal(left), normal(right)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        first = wrong.idxmax()
        return f"{int(wrong.sum())} rows differ, first:\n  spark {a.loc[first].to_dict()}\n  sql   {b.loc[first].to_dict()} {kinds or ''}"
    kinds = {c: k for c, k in kinds.items() if "O" not in (k[0].kind, k[1].kind)}
    return f"types differ {kinds}" if kinds else None


def main(names: list[str]) -> int:
    from gridloom.plans import all_queries
    from gridloom.session import build_session, scratch_scope

    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect()
    failed = []
    todo = {k: q for k, q in all_queries().items() if not names or any(n in k or n == "@" + q.build.__module__.rsplit(".", 1)[1] for n in names)}
    for name, query in todo.items():
        start = time.time()
        try:
            with scratch_scope(spark):
                left = query.run(spark, FOLDER).toPandas()
            spent = time.time() - start
            if query.sql is None:
                problem = None if len(left) else "no rows"
            else:
                problem = compare(left, con.execute(query.sql).df())
            sql_spent = time.time() - start - spent
        except Exception as error:
            problem, spent, sql_spent = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - start, 0
            left = ()
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={len(left)} spark={spent:.2f}s sql={sql_spent:.2f}s"
              f"{'' if query.sql else ' (rows only)'}", flush=True)
        if problem:
            print("   ", problem, flush=True)
            failed.append(name)
    print(f"{len(todo) - len(failed)} of {len(todo)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
