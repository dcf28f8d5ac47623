"""Run registered queries on Spark and their SQL on DuckDB over the same tables, and compare.

    python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weftlink.registry import QUERIES  # noqa: E402
from weftlink.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return repr(float(f"{v:.9g}"))
        if type(v).__name__ == "Decimal":
            return repr(float(f"{float(v):.9g}"))
        if isinstance(v, (list, tuple)):
            return str([cell(x) for x in v])
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, int):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    failures = []
    for name in names:
        try:
            start = time.time()
            df = QUERIES[name].build(spark, sf_dir)
            columns = sorted(df.columns)
            mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
            spent = time.time() - start
            if not QUERIES[name].sql:
                print(f"rows {name}: {len(mine)} rows, {spent:.1f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(QUERIES[name].sql)
            theirs_columns = [d[0] for d in cur.description]
            rows = cur.fetchall()
            duck = time.time() - start
            if sorted(theirs_columns) != columns:
                raise AssertionError(f"columns {columns} vs {sorted(theirs_columns)}")
            order = [theirs_columns.index(c) for c in columns]
            a, b = canonical(mine), canonical([tuple(r[i] for i in order) for r in rows])
            if a != b:
                of_a, of_b = set(a), set(b)
                only_a = [r for r in a if r not in of_b][:3]
                only_b = [r for r in b if r not in of_a][:3]
                raise AssertionError(f"{len(a)} vs {len(b)} rows; spark only {only_a}; sql only {only_b}")
            print(f"same {name}: {len(a)} rows, spark {spent:.1f}s, duckdb {duck:.1f}s", flush=True)
        except Exception as error:  # noqa: BLE001
            failures.append(name)
            print(f"DIFF {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
    print("failures:", failures)
    spark.stop()
    sys.exit(bool(failures))


if __name__ == "__main__":
    main()
