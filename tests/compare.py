"""Run registered queries next to their SQL twins: python -m tests.compare [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v is pd.NA or v != v else (v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    mine, other = canonical(spark_df), canonical(sql_df)
    if mine == other:
        kinds = {c: (str(spark_df[c].dtype), str(sql_df[c].dtype)) for c in spark_df.columns}
        odd = {c: k for c, k in kinds.items() if k[0] != k[1] and "str" not in k[0] + k[1] and set(k) != {"float64", "Int64"}}
        return f"types {odd}" if odd else ""
    left = [r for r in mine if r not in set(other)][:2]
    right = [r for r in other if r not in set(mine)][:2]
    return f"{len(mine)} / {len(other)} rows; only spark {str(left)[:600]}; only sql {str(right)[:600]}"


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            result = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            message = differences(result, con.execute(oracles[name]).df()) if name in oracles else "no oracle"
        except Exception as error:  # noqa: BLE001 - a report line per query
            took, message, result = time.time() - start, f"{type(error).__name__}: {str(error)[:700]}", []
        bad += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {name} {len(result)} rows {took:.1f}s {message}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
