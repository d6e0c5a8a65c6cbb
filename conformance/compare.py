"""Compare registered queries with their SQL twins; used by tests and by hand.

    python -m conformance.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and np.isnan(value)) or value is pd.NA:
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (float, np.floating)):
        return str(int(value)) if float(value).is_integer() else repr(round(float(value), 6))
    return str(value)


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    a, b = sorted(spark_frame.columns), sorted(sql_frame.columns)
    if a != b:
        return f"columns {a} vs {b}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    if left == right:
        return ""
    only_left, only_right = set(left) - set(right), set(right) - set(left)
    return (f"rows {len(left)} vs {len(right)}; only spark {len(only_left)}: "
            f"{sorted(only_left)[:2]}; only sql {len(only_right)}: {sorted(only_right)[:2]}")[:1500]


def main(argv: list[str]) -> int:
    from conformance.cases import ORACLES, QUERIES
    from docketlens.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in ORACLES:
                what = differences(frame, con.execute(ORACLES[name]).df())
                state = "ok" if not what else f"DIFF {what}"
            else:
                state = "rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            took, frame, state = time.time() - start, (), f"ERROR {str(error)[:700]}"
        bad += state not in ("ok", "rows")
        print(f"{name:18s} {took:6.2f}s {len(frame):8d} {state}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
