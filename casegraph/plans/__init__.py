"""Named queries: operators applied to whole given tables, each with the SQL that checks it."""

from casegraph.plans import q_graph, q_log, q_prose, q_records

_PARTS = (q_records, q_graph, q_prose, q_log)


def queries():
    return {name: query for part in _PARTS for name, (query, _) in part.QUERIES.items()}


def oracles():
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
