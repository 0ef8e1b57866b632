"""All registered queries outside the training-data subpackage: name to (Spark query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from biblark.plans import catalog_queries, discovery_queries, event_queries, export_queries, identity_queries, layout_queries, map_queries, note_queries, retrieval_queries, text_queries, title_queries, weaving_queries
from biblark.plans.library import Library


def over_library(query: Callable[[Library], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Library.of(spark, sf_dir))


GROUPS = (catalog_queries, retrieval_queries, event_queries, identity_queries, text_queries, note_queries, layout_queries, title_queries, weaving_queries, export_queries, discovery_queries, map_queries)
QUERIES = {name: over_library(query) for group in GROUPS for name, (query, _) in group.QUERIES.items()}
ORACLE_SQL = {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
