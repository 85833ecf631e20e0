"""Compare registered queries with their SQL twins: ``python -m tests.oracle [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from flowwarden.plans.session import with_settings

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
PLAIN = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]").appName("flowwarden-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    )
    spark = with_settings(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def compare(spark, con, sf_dir, run, sql) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    kinds = {n: PLAIN.get(t, t) for n, t in df.dtypes}
    cur = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in cur.description}
    if sorted(theirs) != names:
        return f"columns {names} vs {sorted(theirs)}"
    odd = {n: (kinds[n], theirs[n]) for n in names if kinds[n] != theirs[n]
           and not (kinds[n] == "VARCHAR" and theirs[n] in ("STRING", "VARCHAR"))
           and not (kinds[n] == "BIGINT" and theirs[n] == "NUMBER")
           and not (kinds[n] == "DOUBLE" and theirs[n] == "NUMBER")}
    order = [list(theirs).index(n) for n in names]
    b = sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=_key)
    a = sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return "values " + str([(n, p, q) for n, p, q in zip(names, x, y) if p != q][:4])
    if odd:
        return f"types {odd}"
    return None


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), database(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, run, oracles[name])
            else:
                problem = None if run(spark, sf_dir).count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4}{name:32}{time.time() - started:6.1f}s {'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
