"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "string": "text", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "date"}
DUCK_KINDS = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "text", "BOOLEAN": "bool", "TIMESTAMP": "time", "DATE": "date"}


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return [_plain(v) for v in x] if isinstance(x, list | tuple) else x


def rows_of(names: list[str], rows) -> list[tuple]:
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in by) for r in rows), key=repr)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty, or what differs: columns, kinds of columns, rows."""
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if not p.exists():
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = {d[0]: DUCK_KINDS.get(str(d[1]), str(d[1])) for d in found.description}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS.get(t, t) != kinds[c] and not t.startswith("array")}
    if odd:
        return f"types {odd}"
    theirs, ours = rows_of(names, found.fetchall()), rows_of(df.columns, df.collect())
    if ours != theirs:
        a, b = [x for x in ours if x not in theirs][:3], [x for x in theirs if x not in ours][:3]
        return f"{len(ours)} and {len(theirs)} rows; only here {a}, only there {b}"
    return ""
