"""Run registered queries next to their SQL and compare rows, columns and types."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, float):
        return repr(value)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def kind(type_name: str) -> str:
    name = type_name.lower()
    return {"varchar": "string", "integer": "int", "double": "double"}.get(name, name).replace(", ", ",")


def compare(spark, con, sf_dir, function, sql):
    """Returns a dict of findings; empty means equal."""
    frame = function(spark, sf_dir)
    start = time.time()
    rows = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    start = time.time()
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    types = {d[0]: kind(str(d[1])) for d in answer.description}
    expected = answer.fetchall()
    sql_took = time.time() - start
    findings = {}
    if sorted(frame.columns) != sorted(names):
        findings["columns"] = (sorted(set(frame.columns) - set(names)), sorted(set(names) - set(frame.columns)))
        return findings, took, sql_took, len(rows)
    spark_types = {f.name: f.dataType.simpleString() for f in frame.schema}
    wrong = {n: (spark_types[n], types[n]) for n in names if spark_types[n] != types[n]}
    if wrong:
        findings["types"] = wrong
    left, right = canonical(frame.columns, rows), canonical(names, expected)
    if left != right:
        only_left, only_right = set(left) - set(right), set(right) - set(left)
        findings["rows"] = (len(left), len(right), sorted(only_left)[:2], sorted(only_right)[:2])
    return findings, took, sql_took, len(rows)


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    print("without sql:", sorted(set(queries) - set(sql)), "without query:", sorted(set(sql) - set(queries)))
    bad = 0
    for name in only or queries:
        try:
            findings, took, sql_took, n = compare(spark, con, sf_dir, queries[name], sql[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            findings, took, sql_took, n = {"error": str(error)[:1500]}, 0, 0, 0
        bad += bool(findings)
        print(f"{'BAD' if findings else 'ok ':4}{name:22}{n:8} rows  spark {took:6.2f}s  sql {sql_took:5.2f}s", flush=True)
        for what, detail in findings.items():
            print("     ", what, str(detail)[:1800])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
