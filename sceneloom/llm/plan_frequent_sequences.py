"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions.text import relation_label
from sceneloom.llm.frequent_sequences import frequent_sequences
from sceneloom.runtime import table


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    chain = F.transform("rst_chain", relation_label)
    return frequent_sequences(table(spark, sf, "structural_matches"), "match_no", chain, 0.06, 3, 5)


_C = "select match_no, [replace(replace(upper(trim(x)), ' ', '_'), '-', '_') for x in max(rst_chain) if x is not null] as c from structural_matches group by 1"
QUERIES = {"p6_found": p6_found}
SQL = {
    "p6_found": f"""
with recursive m as (select * from ({_C}) where len(c) > 0),
n as (select count(*) as n from m),
g as (select match_no, c, 0 as k, 0 as pos, '' as pattern from m
  union all select distinct match_no, c, k + 1, i, case when k = 0 then c[i] else pattern || '>' || c[i] end
  from (select g.*, unnest(range(pos + 1, len(c) + 1)) as i from g where k < 5))
select pattern, count(distinct match_no) as support from g where k between 3 and 5
group by 1 having count(distinct match_no) * 100 >= 6 * (select n from n)"""
}
