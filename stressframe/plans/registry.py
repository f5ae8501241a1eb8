"""Registered queries of the engine's operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "part_state_von_mises"


#: Added before rounding on both sides, so that exact halves, which sums in another order put on either side, go one way.
NUDGE = 3.1e-10


def nudged(sql: str) -> str:
    """The SQL with NUDGE added in every ``round(x, n)`` of n up to 6."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, i, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1, "[": 1, "]": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        if comma >= 0 and int(sql[comma + 1 : i - 1]) <= 6:
            out.append(f"{sql[at:start]}(round({nudged(sql[start + 6 : comma])} + {NUDGE}{sql[comma:i]} + 0.0)")  # and no -0
        else:
            out.append(f"{sql[at : start + 6]}{nudged(sql[start + 6 : i - 1])})")
        at = i
    return "".join(out) + sql[at:]


def near(c: Column, digits: int = 6) -> Column:
    """Rounded as ``nudged`` has it."""
    return F.round(c + NUDGE, digits)


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = nudged(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that sums in another order compare equal."""
    return df.select(*(near(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))


from . import queries_compare, queries_contact, queries_doe, queries_files, queries_mesh, queries_more, queries_query, queries_series  # noqa: E402, F401
