"""All core queries with their oracle SQL."""

from __future__ import annotations

from functools import wraps

from fathomline.plans import data_problems, runs, signals
from fathomline.session import ensure_workers_import

MODULES = [signals, runs, data_problems]
FLAGSHIP = "technology_frequency"


def prepared(query):
    """Let the session's Python workers import the package before the query is planned."""

    @wraps(query)
    def run(spark, folder):
        ensure_workers_import(spark)
        return query(spark, folder)

    return run


QUERIES = {name: prepared(query) for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
