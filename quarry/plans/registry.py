"""All registered plans (driver contract) gathered in one place."""

from __future__ import annotations

from quarry.plans import extract_queries, notes_queries, shape_queries, stream_queries, table_queries

QUERIES = {}
ORACLE = {}
for _mod in (table_queries, extract_queries, notes_queries, shape_queries, stream_queries):
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(_mod.ORACLE)


def flagship(spark, sf_dir):
    return extract_queries.extract_flat(spark, sf_dir)
