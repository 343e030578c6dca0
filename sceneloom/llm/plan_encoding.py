"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.llm.encoding import repair_encoding
from sceneloom.runtime import table


def p9_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return repair_encoding(table(spark, sf, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_repaired(spark, sf).select("doc_id")


# What an accented e and an apostrophe in UTF-8 look like as cp1252.
_TYPICAL = ("Ã©", "â€™")


def p9_typical(spark: SparkSession, sf: str) -> DataFrame:
    """Of the documents found those with an unmistakable sequence: all such documents must be among them."""
    typical = table(spark, sf, "documents").where(F.col("text").contains(_TYPICAL[0]) | F.col("text").contains(_TYPICAL[1])).select("doc_id").distinct()
    return p9_found(spark, sf).join(typical, "doc_id").select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_repaired": p9_repaired, "p9_typical": p9_typical}
SQL = {"p9_typical": f"select distinct doc_id from documents where contains(text, '{_TYPICAL[0]}') or contains(text, '{_TYPICAL[1]}')"}
