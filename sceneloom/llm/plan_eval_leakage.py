"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.llm.eval_leakage import leaked_items
from sceneloom.runtime import table


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "item_text")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """The items that leaked, and into how many documents."""
    items = table(spark, sf, "eval_items").select("item_id", "task", "split").distinct()
    return p8_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents")).join(items, "item_id")


def p8_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """Of the pairs found those whose item stands in the document letter by letter: all such pairs must be among them."""
    docs, items = table(spark, sf, "documents").select("doc_id", "text").distinct(), table(spark, sf, "eval_items").select("item_id", "item_text").distinct()
    return p8_found(spark, sf).join(docs, "doc_id").join(items, "item_id").where(F.contains(F.col("text"), F.col("item_text"))).select("doc_id", "item_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_report": p8_report, "p8_verbatim": p8_verbatim}
# Runs by equal shingles; stretches by the table of the longest common subsequence, row by row, for those that hold enough of the item's words.
# Of what NFKC folds the SQL folds letters and digits of full width.
_WIDE, _PLAIN = ("".join(chr(base + c) for c in range(128) if chr(c).isalnum()) for base in (0xFEE0, 0))
_WORDS = r"regexp_extract_all(lower(regexp_replace(translate(nfc_normalize({}), '" + _WIDE + "', '" + _PLAIN + r"'), '<[^<>]*>', ' ', 'g')), '[\p{{L}}\p{{N}}_]+')"
_FOUND = f"""
with recursive dd as (select distinct doc_id, {_WORDS.format("text")} as w from documents where text is not null), ii as (select distinct item_id, {_WORDS.format("item_text")} as w from eval_items where item_text is not null),
ib as (select item_id, w, len(w) as n, greatest(1, ceil(0.75 * len(w) - 1e-9))::bigint as need, floor(1.25 * len(w) + 1e-9)::bigint as win from ii where len(w) > 0),
iw as (select distinct item_id, unnest(w) as x from ib), dp as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from dd),
po as (select doc_id, item_id, p, row_number() over (partition by doc_id, item_id order by p) as r from dp join iw using (x)),
st as (select a.doc_id, a.item_id, a.p from po a join ib using (item_id) join po b on b.doc_id = a.doc_id and b.item_id = a.item_id and b.r = a.r + ib.need - 1 and b.p - a.p < ib.win),
wi as (select row_number() over () as c, doc_id, item_id, dd.w[p : p + win - 1] as dw, ib.w as w, need from st join ib using (item_id) join dd using (doc_id)),
t as (select c, 0 as i, [0::bigint for j in range(0, len(w) + 1)] as r from wi union all
  select c, i + 1, list_reduce(range(1, len(w) + 1), lambda acc, j: list_append(acc, greatest(acc[-1], r[j + 1], r[j] + (w[j] = dw[i + 1])::bigint)), [0::bigint]) from t join wi using (c) where i < len(dw)),
g as (select distinct item_id, w[k : k + 11] as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from ib)), h as (select distinct doc_id, w[k : k + 11] as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from dd)),
fo as (select doc_id, item_id from t join wi using (c) where r[-1] >= need union select doc_id, item_id from h join g using (g))
"""
SQL = {
    "p8_found": _FOUND + "select doc_id, item_id from fo",
    "p8_report": _FOUND + "select item_id, count(*) as documents, task, split from fo join (select distinct item_id, task, split from eval_items) using (item_id) group by all",
    "p8_verbatim": "select distinct doc_id, item_id from documents, eval_items where contains(text, item_text)",
}
