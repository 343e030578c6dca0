"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sceneloom.llm.top_items import top_items
from sceneloom.runtime import table

TOP = 5


def p4_top_items(spark: SparkSession, sf: str) -> DataFrame:
    return top_items(table(spark, sf, "scored_candidates"), "query_video_id", "video_id", "mlp_score", TOP)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_top_items(spark, sf).select("query_video_id", "video_id")


BEST = """from (select query_video_id, video_id, max(mlp_score) as mlp_score from scored_candidates
where video_id is not null and mlp_score is not null and not isnan(mlp_score) and query_video_id is not null group by 1, 2)
qualify row_number() over (partition by query_video_id order by mlp_score desc, video_id) <= 5"""
QUERIES = {"p4_found": p4_found, "p4_top_items": p4_top_items}
SQL = {
    "p4_found": "select query_video_id, video_id " + BEST,
    "p4_top_items": "select query_video_id, video_id, mlp_score " + BEST,
}
