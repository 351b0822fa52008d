"""Run named queries against their SQL on DuckDB: columns, types and rows must agree."""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _kind(field: T.DataType) -> str:
    names = {
        T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN",
        T.DoubleType: "DOUBLE", T.TimestampNTZType: "TIMESTAMP",
    }
    if isinstance(field, T.DecimalType):
        return f"DECIMAL({field.precision},{field.scale})"
    return names[type(field)]


def _plain(value: object) -> object:
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, Decimal):
        return str(value)
    return value


def differences(spark, con, folder: str, query, sql: str) -> list[str]:
    result = query(spark, folder)
    names = sorted(result.columns)
    mine_types = {f.name: _kind(f.dataType) for f in result.schema.fields}
    cursor = con.execute(sql)
    theirs_types = {d[0]: str(d[1]) for d in cursor.description}
    problems = []
    if set(theirs_types) != set(names):
        return [f"columns {names} vs {sorted(theirs_types)}"]
    problems += [f"type of {n}: {mine_types[n]} vs {theirs_types[n]}" for n in names if mine_types[n] != theirs_types[n]]
    order = [list(theirs_types).index(n) for n in names]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    mine = Counter(tuple(_plain(row[n]) for n in names) for row in result.collect())
    if mine != theirs:
        problems.append(
            f"rows {sum(mine.values())} vs {sum(theirs.values())}; "
            f"only here {list((mine - theirs).items())[:2]}; only there {list((theirs - mine).items())[:2]}"
        )
    elif not mine:
        problems.append("both empty")
    return problems


def main() -> None:
    from gavelspark.session import build_session
    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            if name in sql:
                found = differences(spark, con, folder, query, sql[name])
            else:
                found = [] if query(spark, folder).count() else ["no rows"]
        except Exception as error:
            found = [str(error)[:600]]
        bad += bool(found)
        print(f"@@ {'BAD' if found else 'ok '} {name} {time.time() - begin:.1f}s {'; '.join(found)}", flush=True)
    print(f"@@ {bad} bad")


if __name__ == "__main__":
    main()
