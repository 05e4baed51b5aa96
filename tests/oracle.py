"""Run a query and its SQL on the same tables, and compare names, kinds, counts and values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "HUGEINT": "hugeint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATE": "date"}


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return v + 0.0
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def differences(df, sql: str, c) -> list[str]:
    """What differs; empty if nothing does. Doubles may differ in the last rounded digit."""
    rel = c.sql(sql)
    kinds = {n: KINDS.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    mine = dict(df.dtypes)
    if set(kinds) != set(mine):
        return [f"columns {sorted(mine)} against {sorted(kinds)}"]
    out = [f"{k}: {mine[k]} against {kinds[k]}" for k in kinds if mine[k].replace("timestamp_ntz", "timestamp") != kinds[k]]
    cols = sorted(kinds)
    sort = lambda rows: sorted(rows, key=lambda x: [(isinstance(v, str), isinstance(v, bool), str(v) if isinstance(v, str) else v) if v != "null" else (2, 0, "") for v in x])
    a = [tuple(_cell(r[k]) for k in cols) for r in df.select(*cols).collect()]
    b = [tuple(map(_cell, r)) for r in c.sql(f"SELECT {', '.join(chr(34) + k + chr(34) for k in cols)} FROM ({sql}) q").fetchall()]
    if len(a) != len(b):
        return [*out, f"{len(a)} rows against {len(b)}"]
    exact = set(a) == set(b)
    if not exact:
        bad = 0
        first = ""
        for x, y in zip(sort(a), sort(b)):
            same = all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1.5e-3 * max(1, abs(q))) for p, q in zip(x, y))
            if not same:
                bad += 1
                first = first or f"{dict(zip(cols, x))} against {dict(zip(cols, y))}"
        only = sorted(set(a) - set(b), key=str)[:1], sorted(set(b) - set(a), key=str)[:1]
        out.append(f"{len(set(a) - set(b))} rows not equal, {bad} beyond the tolerance; {first or only}")
    return out
