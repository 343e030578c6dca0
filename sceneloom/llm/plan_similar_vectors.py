"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.llm.similar_vectors import similar_vectors
from sceneloom.runtime import table


def p3_similar_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return similar_vectors(table(spark, sf, "scene_vectors"), "scene_uid", "embedding", "written_at", 5, 64, 0.9)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    near = p3_similar_vectors(spark, sf)
    return near.select(F.least("scene_uid", "neighbour").alias("scene_a"), F.greatest("scene_uid", "neighbour").alias("scene_b")).distinct()


_NEAR = """
with v as (select scene_uid as u, cast(embedding as double[]) as e from scene_vectors qualify row_number() over (partition by scene_uid order by written_at desc) = 1),
s as (select u, e, sqrt(list_sum([x * x for x in e])) as n from v where len(e) = 64 and len([x for x in e if x is null or not isfinite(x)]) = 0),
p as (select a.u as a, b.u as b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 4) as c from s a, s b where a.u <> b.u and a.n > 0 and b.n > 0),
r as (select * from p where c >= 0.9 qualify row_number() over (partition by a order by c desc, b) <= 5)
"""
QUERIES = {"p3_found": p3_found, "p3_similar_vectors": p3_similar_vectors}
SQL = {
    "p3_found": _NEAR + "select distinct least(a, b) as scene_a, greatest(a, b) as scene_b from r",
    "p3_similar_vectors": _NEAR + "select a as scene_uid, b as neighbour, c as cosine from r",
}
