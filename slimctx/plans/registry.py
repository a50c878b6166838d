"""All registered queries and their DuckDB oracles, keyed as in SURVEY §7.3."""

from __future__ import annotations

from slimctx.plans.corpus_queries import CORPUS_QUERIES
from slimctx.plans.log_queries import LOG_QUERIES
from slimctx.plans.oracle_corpus import CORPUS_SQL
from slimctx.plans.oracle_log import LOG_SQL

QUERIES = {}
QUERIES.update(LOG_QUERIES)
QUERIES.update(CORPUS_QUERIES)

ORACLE_SQL = {}
ORACLE_SQL.update(LOG_SQL)
ORACLE_SQL.update(CORPUS_SQL)


def flagship(spark, sf_dir):
    """Which files save the most context when pruned (depth-3 sweep)."""
    return QUERIES["sweep_top_savers"](spark, sf_dir)
