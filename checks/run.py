"""Runs registered queries and their SQL on the same tables and reports differences and times.

    python -m checks.run /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from seqdrift.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def canonical(rows: list[tuple]) -> list[tuple]:
    def one(v):
        if v is None:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, (int, float)):
            v = float(v)
            return (2, "nan" if math.isnan(v) else repr(round(v, 9) + 0.0))
        return (3, str(v))

    return sorted(tuple(one(v) for v in row) for row in rows)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_rows: tuple[list[str], list[tuple]], sql_rows: tuple[list[str], list[tuple]]) -> str:
    """Empty when both agree on column names and on the values as a multiset."""
    (sc, sr), (qc, qr) = spark_rows, sql_rows
    if sorted(sc) != sorted(qc):
        return f"columns {sorted(sc)} / {sorted(qc)}"
    if len(sr) != len(qr):
        return f"rows {len(sr)} / {len(qr)}"
    so = [sc.index(c) for c in sorted(sc)]
    qo = [qc.index(c) for c in sorted(qc)]
    a, b = canonical([tuple(r[i] for i in so) for r in sr]), canonical([tuple(r[i] for i in qo) for r in qr])
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""


def main(sf_dir: str, parts: list[str]) -> int:
    from checks.catalog import ORACLES, QUERIES

    spark = local_session()
    con = database(sf_dir)
    failures = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            rows = (df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name in ORACLES:
                start = time.time()
                cur = con.execute(ORACLES[name])
                expected = ([d[0] for d in cur.description], cur.fetchall())
                message = compare(rows, expected) or "ok"
                message += f" ({time.time() - start:.2f}s sql)"
            else:
                message = "rows only"
        except Exception as e:  # noqa: BLE001 - a report goes on with the next query
            took = time.time() - start
            message = f"{type(e).__name__}: {str(e)[:1500]}"
            rows = ([], [])
        good = message.startswith(("ok", "rows only"))
        failures += not good
        print(f"{'  ' if good else '! '}{name:34s} {took:7.2f}s {len(rows[1]):7d} rows  {message}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
