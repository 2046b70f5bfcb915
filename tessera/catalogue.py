"""All queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import candidate_queries, decision_queries, event_queries, fact_queries, macro_queries, market_queries, nowcast_queries, payload_queries, rule_queries, staging_queries, status_queries, study_queries, text_queries, update_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (market_queries, text_queries, rule_queries, macro_queries, status_queries, event_queries, nowcast_queries, payload_queries, update_queries, fact_queries, staging_queries, candidate_queries, study_queries, decision_queries)
FLAGSHIP = "strategy_metrics"


def _dates_as_text(query: Query, dates: list[str]) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).withColumns({d: F.col(d).cast("string") for d in dates})

    return run


QUERIES: dict[str, Query] = {name: _dates_as_text(q, m.DATES[name]) if name in m.DATES else q for m in MODULES for name, q in m.QUERIES.items()}
SQL: dict[str, str] = {
    name: f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in m.DATES[name])}) FROM ({sql})" if name in m.DATES else sql
    for m in MODULES for name, sql in m.SQL.items()
}
