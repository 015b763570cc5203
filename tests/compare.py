"""Run a registered query and its SQL twin over the same tables and compare them."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


KINDS = {"bigint": "bigint", "int": "int", "integer": "int", "double": "double", "string": "varchar", "varchar": "varchar",
         "boolean": "boolean", "float": "float"}


def compare(spark: SparkSession, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    cols = sorted(df.columns)
    left = sorted(tuple(_plain(r[c]) for c in cols) for r in rows)
    rel = con.sql(sql)
    names = sorted(rel.columns)
    data = rel.fetchall()
    t2 = time.time()
    took = f"rows={len(rows)} spark={t1 - t0:.2f}s duckdb={t2 - t1:.2f}s"
    if cols != names:
        return False, f"columns {cols} != {names}"
    order = [rel.columns.index(c) for c in names]
    right = sorted(tuple(_plain(r[i]) for i in order) for r in data)
    ltypes = {c: KINDS.get(t, t) for c, t in df.dtypes}
    rtypes = {c: KINDS.get(str(t).lower(), str(t).lower()) for c, t in zip(rel.columns, rel.types)}
    bad = {c: (ltypes[c], rtypes[c]) for c in cols if ltypes[c] != rtypes[c]}
    if bad and not all("(" in a[0] or "array" in a[0] or "timestamp" in a[0] for a in bad.values()):
        return False, f"types {bad} {took}"
    if len(left) != len(right):
        return False, f"row counts spark {len(left)} duckdb {len(right)}: {took}"
    if left != right:
        diff = [(a, b) for a, b in zip(left, right) if a != b]
        return False, f"{len(diff)} rows differ, columns {cols}: {diff[:3]} {took}"
    if not left:
        return False, "empty result " + took
    return True, took


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            if name in oracles:
                ok, note = compare(spark, con, query, oracles[name], sf_dir)
            else:
                t0 = time.time()
                rows = query(spark, sf_dir).collect()
                ok, note = bool(rows), f"rows-only rows={len(rows)} spark={time.time() - t0:.2f}s {rows[0] if rows else ''}"[:300]
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
