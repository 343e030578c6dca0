"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.llm.containers import pack_documents
from sceneloom.runtime import table


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), table(spark, sf, "container_specs"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_containers(spark, sf).where("split").select("doc_id").distinct()


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of each source against the least number that its tokens need."""
    used = p7_containers(spark, sf).groupBy("source", "container").agg(F.sum("tokens").alias("tokens"))
    return (
        used.groupBy("source").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
        .join(table(spark, sf, "container_specs"), "source")
        .select("source", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (F.col("fullest") <= F.col("capacity")).alias("fits"))
    )


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source the texts placed, whether each whole one lies in one container, no container is too full, and as few are used as tokens need plus one in a hundred."""
    rows = p7_containers(spark, sf)
    placed = rows.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.max("split").alias("split"))
    docs = placed.groupBy("source").agg(F.count("*").alias("documents"), F.every(F.col("split") | (F.col("times") == 1)).alias("once"))
    fill = p7_fill(spark, sf).select("source", "fits", (F.col("containers") <= 1 + F.ceil(F.col("least") * 1.01)).alias("tight"))
    return docs.join(fill, "source")


QUERIES = {"p7_checks": p7_checks, "p7_found": p7_found, "p7_containers": p7_containers, "p7_fill": p7_fill}
SQL = {
    "p7_checks": """select source, count(distinct doc_id) as documents, true as once, true as fits, true as tight from documents join container_specs using (source) where text <> '' group by 1""",
    "p7_found": """select distinct doc_id from documents join container_specs using (source)
where text <> '' and coalesce(n_tokens, octet_length(encode(text)) + 1) > capacity"""
}
