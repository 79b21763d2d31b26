"""Run named queries on Spark and their SQL on DuckDB and compare all rows.

    python tests/compare.py 0.01            # all
    python tests/compare.py 0.01 name ...   # some
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, int):
        return v
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, otherwise what differs."""
    df = fn(spark, sf_dir)
    got_cols, got = _rows(df.columns, df.collect())
    result = con.execute(sql)
    want_cols, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{str(g)[:700]}\n   != {str(w)[:700]}"
    # Equal values of different types would still count as a mismatch elsewhere.
    kinds = {type(v) for g in got for v in g} - {type(None)}
    other = {type(v) for w in want for v in w} - {type(None)}
    return None if kinds == other else f"types {kinds} != {other}"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reviewspark-tests")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf: str, names: list[str]) -> int:
    from reviewspark.catalogue import ORACLE, QUERIES

    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            if name in ORACLE:
                wrong = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
                note = "equal" if wrong is None else wrong
            else:
                wrong, note = None, f"rows only: {len(QUERIES[name](spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            wrong = note = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += wrong is not None
        print(f"{'FAIL' if wrong else 'ok  '} {name} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
