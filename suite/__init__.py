"""Registered queries: every operator of the package over the given tables, with its oracle SQL."""

from suite import cells, filters, overviews, pages, profiles, sources, table_queries

GROUPS = (filters, pages, table_queries, overviews, profiles, cells, sources)


def all_queries():
    return {name: entry[0] for group in GROUPS for name, entry in group.QUERIES.items()}


def all_oracles():
    return {
        name: entry[1]
        for group in GROUPS
        for name, entry in group.QUERIES.items()
        if entry[1] is not None
    }
