"""All registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from lorewell.plans import conversations, library, storage, texts, vector_graph

QUERIES: dict = {}
SQL: dict = {}
for _part in (vector_graph, conversations, texts, library, storage):
    QUERIES.update(_part.QUERIES)
    SQL.update(_part.SQL)
