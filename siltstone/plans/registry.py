"""QUERIES: name -> f(spark, sf_dir); SQL: name -> DuckDB text giving the same rows."""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL when there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def load() -> None:
    """Import the query modules, which register themselves."""
    from siltstone.plans import code_queries, graph_queries, reach_queries, refmap_queries, resolve_queries, search_queries, state_queries  # noqa: F401
