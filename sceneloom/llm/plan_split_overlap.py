"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions.text import VIDEO_ID, split_name
from sceneloom.llm.split_overlap import linked_classes, linked_pairs, name_links, overlap_counts, text_links
from sceneloom.runtime import cut, table


def _side(df: DataFrame) -> DataFrame:
    return df.withColumn("train", split_name("split") == "train")


def _links(spark: SparkSession, sf: str, kind: str) -> tuple[DataFrame, DataFrame]:
    if kind == "video":
        named = F.regexp_extract("video_id", VIDEO_ID, 1)
        return name_links(_side(table(spark, sf, "video_samples")).withColumn("name", F.when(named != "", named)), "sample_no", "name", "train")
    return text_links(_side(table(spark, sf, "scenes")), "scene_no", "caption", "train")


def _pairs(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    pairs = linked_pairs(*_links(spark, sf, kind))
    return pairs.select(F.lit(kind).alias("kind"), F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")).distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "video").unionByName(_pairs(spark, sf, "caption"))


def p5_videos(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "video")


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each record that occurs on the other side too: its class and its number of partners."""
    parts = []
    for kind in ("video", "caption"):
        members, links = _links(spark, sf, kind)
        parts.append(linked_classes(members, cut(links)).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed pairs by kind, evaluation split and both sources, counted by classes."""
    parts = []
    for kind, name, key in (("video", "video_samples", "sample_no"), ("caption", "scenes", "scene_no")):
        of = table(spark, sf, name).groupBy(F.col(key).alias("key")).agg(F.max(split_name("split")).alias("split"), F.max("source").alias("source"))
        members, links = _links(spark, sf, kind)
        parts.append(overlap_counts(members, cut(links), of).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def p5_identical(spark: SparkSession, sf: str) -> DataFrame:
    """Of the caption pairs those of one and the same text of twenty words and more: all such pairs must be among them."""
    c = table(spark, sf, "scenes").select("scene_no", "caption").distinct().where(F.size(F.split("caption", " ")) >= 20)
    a, b = (c.select(F.col("scene_no").alias(k), F.col("caption").alias(t)) for k, t in (("key_a", "ta"), ("key_b", "tb")))
    return p5_found(spark, sf).where("kind = 'caption'").join(a, "key_a").join(b, "key_b").where("ta = tb").select("key_a", "key_b")


_SIDE = "lower(trim(split)) in ('train', 'training') as t, case when lower(trim(split)) in ('val', 'validation') then 'val' else lower(trim(split)) end as split"
_KNOWN = "lower(trim(split)) in ('train', 'training', 'val', 'validation', 'test')"
# The word edit distance is worked out row by row of its table for the pairs whose sets of words allow it.
_FOUND = rf"""
with recursive v as (select distinct sample_no as k, regexp_extract(video_id, '([A-Za-z0-9_-]{{11}})(\.[A-Za-z0-9]+)?\s*$', 1) as v, {_SIDE} from video_samples where {_KNOWN}),
s as (select distinct scene_no as k, regexp_extract_all(lower(regexp_replace(nfc_normalize(caption), '<[^<>]*>', ' ', 'g')), '[\p{{L}}\p{{N}}_]+') as w, {_SIDE} from scenes where {_KNOWN} and caption is not null),
x as (select k, t, w, len(w) as n, list_distinct(w) as d from s where len(w) >= 8), cl as (select row_number() over () as c, w, n, d, bool_or(t) as some, bool_and(t) as every from x group by w, n, d),
cand as (select a.c as a, b.c as b, a.w as aw, b.w as bw, greatest(a.n, b.n) // 15 as most from cl a join cl b on a.some and not b.every and abs(a.n - b.n) <= greatest(a.n, b.n) // 15
  where len(a.d) - len(list_intersect(a.d, b.d)) <= greatest(a.n, b.n) // 15 and len(b.d) - len(list_intersect(a.d, b.d)) <= greatest(a.n, b.n) // 15),
t as (select a, b, 0 as i, range(0, len(bw) + 1) as r from cand union all
  select a, b, i + 1, list_reduce(range(1, len(bw) + 1), lambda acc, j: list_append(acc, least(acc[-1] + 1, r[j + 1] + 1, r[j] + (aw[i + 1] <> bw[j])::bigint)), [i::bigint + 1]) from t join cand using (a, b) where i < len(aw) and list_min(r) <= most),
li as (select a, b from t join cand using (a, b) where i = len(aw) and r[-1] <= most),
fo as (select distinct 'video' as kind, a.k as tk, b.k as ek from v a join v b on a.v = b.v and a.v <> '' and a.t and not b.t
  union all select distinct 'caption', a.k, b.k from li join cl ca on ca.c = li.a join cl cb on cb.c = li.b join x a on a.w = ca.w and a.t join x b on b.w = cb.w and not b.t)
"""
QUERIES = {"p5_found": p5_found, "p5_identical": p5_identical, "p5_videos": p5_videos, "p5_classes": p5_classes, "p5_report": p5_report}
SQL = {
    "p5_found": _FOUND + "select kind, least(tk, ek) as key_a, greatest(tk, ek) as key_b from fo group by all",
    "p5_classes": _FOUND + """, me as (select 'video' as kind, k, t, min(k) over (partition by v) as class from v where v <> '' union all select 'caption', k, t, min(k) over (partition by w) from x)
select me.kind, k as key, t as train, class, count(*) as links from me join fo on fo.kind = me.kind and case when t then tk else ek end = k group by all""",
    "p5_report": _FOUND + f""", y as (select 'video' as kind, sample_no as k, max(case when {_KNOWN} then case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'validation') then 'val' else 'test' end end) as split, max(source) as source from video_samples group by 2
  union all select 'caption', scene_no, max(case when {_KNOWN} then case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'validation') then 'val' else 'test' end end), max(source) from scenes group by 2)
select fo.kind, e.split, e.source as eval_source, t.source as train_source, count(*) as pairs, count(distinct ek) as eval_records
from fo join y t on t.kind = fo.kind and t.k = tk join y e on e.kind = fo.kind and e.k = ek group by all""",
    "p5_identical": """
with s as (select distinct scene_no as k, caption as c, lower(trim(split)) in ('train', 'training') as t from scenes
  where lower(trim(split)) in ('train', 'training', 'val', 'validation', 'test') and len(string_split(caption, ' ')) >= 20)
select distinct least(a.k, b.k) as key_a, greatest(a.k, b.k) as key_b from s a join s b on a.c = b.c and a.t and not b.t""",
    "p5_videos": r"""
with s as (select distinct sample_no as k, regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) as v,
  lower(trim(split)) in ('train', 'training') as t from video_samples where lower(trim(split)) in ('train', 'training', 'val', 'validation', 'test'))
select distinct 'video' as kind, least(a.k, b.k) as key_a, greatest(a.k, b.k) as key_b from s a join s b on a.v = b.v and a.v <> '' and a.t and not b.t"""
}
