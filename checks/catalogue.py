"""All registered queries in one place.  SQL is built when it is asked for."""

from __future__ import annotations

from checks import language_queries, link_queries, record_queries, site_queries, text_queries, vector_queries

_MODULES = (text_queries, link_queries, site_queries, vector_queries, language_queries, record_queries)
_ALL = {name: entry for module in _MODULES for name, entry in module.QUERIES.items()}


def queries():
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql():
    built = {name: sql() if callable(sql) else sql for name, (_, sql) in _ALL.items()}
    return {name: sql for name, sql in built.items() if sql is not None}
