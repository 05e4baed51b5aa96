"""Queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values are compared on a decimal grid. Prices and their means often lie half-way between two of its points,
#: where engines round either way; the grid is therefore shifted by an odd amount.
SHIFT = 0.1863

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def snapped(sql: str) -> str:
    """``round(E, d)`` in SQL text as the snapping of ``r``, so that both sides snap alike."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        if start and (sql[start - 1].isalnum() or sql[start - 1] == "_"):
            out.append(sql[at : start + 6])
            at = start + 6
            continue
        depth, comma, k = 1, -1, start + 6
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                comma = k
            k += 1
        body, digits = snapped(sql[start + 6 : comma]), sql[comma + 1 : k - 1].strip()
        out += [sql[at:start], f"(round(CAST({body} AS DOUBLE) * 1e{digits} - {SHIFT}) / 1e{digits} + 0e0)"]
        at = k
    return "".join([*out, sql[at:]])


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and the SQL of its rows where there is one."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = snapped(sql)
        return fn

    return keep


def snap(c: Column, digits: int) -> Column:
    return F.rint(c.cast("double") * float(10**digits) - SHIFT) / float(10**digits) + F.lit(0.0)


def r(c: str | Column, name: str = "", digits: int = 4) -> Column:
    """A double on a grid of ``digits`` decimals, with -0 as 0."""
    return snap(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)
