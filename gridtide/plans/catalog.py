"""Registry of the runnable queries and their SQL equivalents."""

from gridtide.plans.binding import Tables

QUERIES = {}
ORACLES = {}


def query(sql=None):
    """Register a function of `Tables` under its own name, with the SQL that must give the same rows."""

    def register(build):
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load():
    """Import the modules that register queries."""
    from gridtide.plans import (  # noqa: F401
        alert_queries,
        check_queries,
        cleaning_queries,
        feature_queries,
        hourly_queries,
        model_queries,
        quality_queries,
        serving_queries,
        warehouse_queries,
    )

    return QUERIES, ORACLES
