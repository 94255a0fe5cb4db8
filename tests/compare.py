"""Compare catalog queries with their SQL twins: ``python tests/compare.py SF_DIR [NAME…]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return (str(value), 0.0)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return ("", math.inf if math.isnan(value) else float(value))
    return (str(value), 0.0)


def _ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str, tolerance: float = 1e-9) -> str | None:
    """What differs between the two results, or None."""
    got_names, got = _ordered(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = con.sql(sql)
    want_names, want = _ordered(found.columns, found.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    for g, w in zip(got, want):
        if any(a[0] != b[0] or abs(a[1] - b[1]) > tolerance for a, b in zip(g, w)):
            return f"{got_names}: {str(g)[:300]} != {str(w)[:300]}"
    return None


def main() -> None:
    from readgauge.plans.catalog import QUERIES
    from readgauge.plans.oracles import ORACLES
    from readgauge.session import build_session

    sf_dir, *names = sys.argv[1:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.codegen.fallback": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            note = difference(df, con, ORACLES[name]) if name in ORACLES else f"{len(df.collect())} rows (no SQL)"
            state = "ok  " if note is None or name not in ORACLES else "DIFF"
        except Exception as error:
            state, note = "FAIL", str(error)[:600]
        bad += state in ("DIFF", "FAIL")
        print(f"{state} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} differ")


if __name__ == "__main__":
    main()
