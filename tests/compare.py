"""Run registered queries beside their oracle SQL and compare whole results.

    python -m tests.compare sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: str = "8") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName("boardstat")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"{v:.9f}".rstrip("0").rstrip(".")
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    try:
        return f"{float(v):.9f}".rstrip("0").rstrip(".") if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def _kind(name: str) -> str:
    if name.endswith("]") or name.startswith("array"):
        return "array"
    for kind, words in {"whole": ("int", "integer", "bigint", "smallint", "long"), "real": ("double", "float"),
                        "text": ("string", "varchar"), "flag": ("boolean",)}.items():
        if name in words:
            return kind
    return name.split("(")[0].split("_")[0].split(" ")[0]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def check(spark, con, name, query, sql, sf_dir) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return True, f"{len(got)} rows, no oracle"
    cur = con.execute(sql)
    ecols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ecols:
        return False, f"columns {cols} vs {ecols}"
    kinds = {c: _kind(t) for c, t in df.dtypes}
    other = {d[0]: _kind(str(d[1]).lower()) for d in cur.description}
    if kinds != other:
        return False, f"types {[(c, kinds[c], other[c]) for c in cols if kinds[c] != other[c]]}"
    if got != want:
        g, w = set(got) - set(want), set(want) - set(got)
        return False, (f"rows {len(got)} vs {len(want)}; {cols}\n   only spark {sorted(g)[:2]}"
                       f"\n   only sql   {sorted(w)[:2]}")
    return True, f"{len(got)} rows"


def main() -> None:
    import __spark_entry__ as e
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark, con = session(os.environ.get("CORES", "8")), duck(sf_dir)
    queries, oracle = e.queries(), e.oracle_sql()
    names = sys.argv[2:] or list(queries)
    names = [n for n in queries if n in names or any(p.endswith("*") and n.startswith(p[:-1]) for p in names)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            ok, text = check(spark, con, n, queries[n], oracle.get(n), sf_dir)
        except Exception as ex:  # report every query, then fail
            ok, text = False, "".join(traceback.format_exception_only(ex))[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:32s} {time.time() - t:6.2f}s  {text}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
