"""Runs registered queries beside their SQL on the same tables: python tests/compare.py FOLDER [PREFIX...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    return value


def same(spark, folder: str, name: str) -> str:
    """Empty if the query and its SQL agree."""
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = connection.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    if mine == theirs:
        return ""
    a, b = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
    return f"{len(mine)} and {len(theirs)} rows; only here {str(a)[:300]}; only in SQL {str(b)[:300]}"


if __name__ == "__main__":
    from conftest import session

    spark = session()
    for name in entry.queries():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        began = time.time()
        try:
            said = same(spark, sys.argv[1], name) if name in entry.oracle_sql() else f"rows only: {entry.queries()[name](spark, sys.argv[1]).count()}"
        except Exception as e:
            said = "FAILED " + str(e)[:500].replace("\n", " ")
        print(f"{name:28} {time.time() - began:5.1f} s  {said or 'same'}", flush=True)
