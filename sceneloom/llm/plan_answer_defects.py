"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.llm.answer_defects import answer_defects, main_defect
from sceneloom.runtime import cut, table


def p2_labels(spark: SparkSession, sf: str) -> DataFrame:
    return answer_defects(table(spark, sf, "predictions"), "record_no")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return main_defect(cut(p2_labels(spark, sf)), "record_no")


def p2_blank(spark: SparkSession, sf: str) -> DataFrame:
    """Of the records found to be empty those without any explanation: all such records must be among them."""
    said = table(spark, sf, "predictions").groupBy("record_no").agg(F.max(F.trim(F.coalesce("explanation", F.lit("")))).alias("said"))
    return p2_found(spark, sf).where("defect = 'empty'").join(said.where("said = ''"), "record_no").select("record_no")


QUERIES = {"p2_found": p2_found, "p2_labels": p2_labels, "p2_blank": p2_blank}
SQL = {"p2_blank": "select record_no from predictions group by 1 having max(trim(coalesce(explanation, ''), ' ')) = ''"}
