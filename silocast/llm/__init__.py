"""Operations of a large training-data pipeline, each a Spark job.

Nothing outside this package imports it. ``queries()`` and ``oracle_sql()``
gather what the modules register.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "imatch", "sharding", "packing", "mixing", "langid", "licenses", "simhash", "toxicity", "linededup", "vectors",
    "repair", "fim", "quality",
)


def queries() -> dict:
    """All queries of this package by name."""
    out: dict = {}
    for name in MODULES:
        out.update(import_module(f"{__name__}.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), "ORACLES", {}))
    return out
