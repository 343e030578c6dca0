"""Queries of segmentation, trees, ingest checks, streaming and fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneloom.functions.rst_tree import tree_links, tree_spans
from sceneloom.functions.vectors import cosine
from sceneloom.operators import models as ml
from sceneloom.operators import segmentation as sg
from sceneloom.operators.concepts import centres
from sceneloom.operators.evidence import prior
from sceneloom.plans.discourse import LINKS
from sceneloom.plans.discourse import clean_links as links
from sceneloom.sources.readers import checked_videos
from sceneloom.sources.writers import scene_index as scene_rows
from sceneloom.streaming.incremental import new_videos, run_to_table, sessions
from sceneloom.runtime import cut, shared_dir, table

GAP = 300.0  # least distance of two boundaries of a signal, in event numbers
FIT_ROWS = 50_000  # rows that the triple scorer is fitted on


def transcript_gaps(spark: SparkSession, sf: str) -> DataFrame:
    g = sg.gaps(sg.segments(table(spark, sf, "scenes")))
    return g.select("video_id", F.round("middle", 4).alias("middle"), F.round("gap", 4).alias("gap"))


def stt_gap_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return sg.gap_boundaries(sg.segments(table(spark, sf, "scenes"))).select("video_id", F.round("boundary", 4).alias("boundary"))


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "value").where("value is not null")


def silence_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sg.silence_runs(_signal(spark, sf), "user_id", "event_id", "value", 10.0, 2)


def silence_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return sg.silence_boundaries(_signal(spark, sf), "user_id", "event_id", "value", 10.0, 2, GAP)


def signal_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return sg.spikes(_signal(spark, sf), "user_id", "event_id", "value", sigma=1.0, gap=GAP).select("user_id", "event_id", F.round("rise", 6).alias("rise"))


def signal_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return sg.maxima(_signal(spark, sf), "user_id", "event_id", "value", sigma=0.5, gap=GAP).select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


def video_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Videos cut at their pauses, to the millisecond, at three pieces."""
    s = sg.segments(table(spark, sf, "scenes"))
    b = sg.gaps(s, 1.0).groupBy("video_id").agg(F.collect_list(F.floor(F.col("middle") * 1000) / 1000).alias("b"))
    d = s.groupBy("video_id").agg(F.max("end").alias("d")).join(b, "video_id", "left")
    n = d.select("video_id", F.posexplode(sg.nodes(F.coalesce("b", F.array().cast("array<double>")), "d")).alias("node", "s"))
    return n.select("video_id", "node", "s.start", "s.end")


def transcript_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Segments aligned to the scenes they were taken from, each shifted back by half a second."""
    s = sg.segments(table(spark, sf, "scenes"))
    scenes = s.groupBy("video_id", "scene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    said = s.select("video_id", (F.col("start") - 0.5).alias("start"), (F.col("end") - 0.5).alias("end"), F.col("seg").cast("string").alias("text"), "speaker")
    return sg.align_transcripts(scenes.drop("scene_id"), said)


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    """A right-branching tree over the relations of each video, in link order."""
    r = links(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("link_pos", "rel"))).alias("l"))
    n = F.size("l")
    heads = F.transform("l", lambda x, i: F.format_string("(nucleus-satellite:%s (text %d) ", F.lower(x["rel"]), i))
    return r.select("video_id", F.concat(F.array_join(heads, ""), F.format_string("(text %d)", n), F.repeat(F.lit(")"), n)).alias("tree"))


def tree_to_links(spark: SparkSession, sf: str) -> DataFrame:
    return _trees(spark, sf).select("video_id", F.inline(tree_links("tree")))


def tree_to_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _trees(spark, sf).select("video_id", F.inline(tree_spans("tree")))


def tree_to_links_left(spark: SparkSession, sf: str) -> DataFrame:
    """The links of left-branching trees, whose inner nodes are the nuclei of the outer ones."""
    r = links(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("link_pos", "rel"))).alias("l"))
    heads = F.reverse(F.transform("l", lambda x: F.format_string("(nucleus-satellite:%s ", F.lower(x["rel"]))))
    tails = F.transform("l", lambda x, i: F.format_string(" (text %d))", i + 1))
    return r.select("video_id", F.inline(tree_links(F.concat(F.array_join(heads, ""), F.lit("(text 0)"), F.array_join(tails, "")))))


def validated_videos(spark: SparkSession, sf: str) -> DataFrame:
    return checked_videos(table(spark, sf, "video_samples"), table(spark, sf, "scene_vectors"), table(spark, sf, "rst_links"))


def scene_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = scene_rows(table(spark, sf, "scenes"), table(spark, sf, "scene_vectors"), table(spark, sf, "video_samples"))
    return rows.select("scene_uid", "video_id", "scene_id", "video_label", "caption", F.size("vector").alias("dim"))


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table of the graph; an empty table counts 0."""
    parts = [table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("video_samples", "scenes", "rst_links", "scene_vectors")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(table(spark, sf, "events"), "user_id", "ts", "30 minutes")
    return s.select("user_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")), "n")


def stream_new_videos(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a stream: every video once, written exactly once; rows may be four months late."""
    src = table(spark, sf, "video_samples").select("video_id", "ingested_at")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    src.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{at}/in")
    return run_to_table(new_videos(stream, "video_id", "ingested_at", "150 days"), f"{at}/out", f"{at}/log").select("video_id")


def concept_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return ml.clustered(ml.cluster_model(e, "embedding", 10, dims=8), e, "embedding").select("vec_id", "cluster")


def concept_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The two most probable components of each scene."""
    e = table(spark, sf, "embeddings")
    m = ml.clustered(ml.cluster_model(e, "embedding", 4, dims=4, mixture=True), e, "embedding")
    return m.select("vec_id", F.posexplode(ml.top_clusters("proba", 2)).alias("rank", "t")).select("vec_id", "rank", "t.cluster", F.round("t.p", 4).alias("p"))


def cluster_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    d = ml.diagnostics(table(spark, sf, "embeddings").withColumnRenamed("label", "cluster"))
    return d.withColumn("largest_share", F.round("largest_share", 6))


def cluster_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and silhouette of the clusters of ``concept_kmeans``."""
    e = table(spark, sf, "embeddings")
    c = cut(ml.clustered(ml.cluster_model(e, "embedding", 10, dims=8), e, "embedding").select("cluster", "embedding"))
    return ml.diagnostics(c).withColumn("silhouette", F.lit(round(ml.silhouette(c, "embedding"), 4)))


def triple_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score of the perceptron by relation over all concept triples, whatever their label; it is fitted on at most FIT_ROWS of those labelled 0 or 1.

    The prior is that of the triple, the cosine that of the two concepts' centres (0 where a concept has none).
    """
    from pyspark.ml.functions import vector_to_array

    t = table(spark, sf, "scored_candidates").where("c_src is not null and c_tgt is not null and rst_type is not null")
    num = lambda c: F.regexp_extract(c, r"\d+", 0).cast("double")
    key = ["c_src", "rst_type", "c_tgt"]
    c = centres(table(spark, sf, "embeddings").withColumn("concept", F.concat(F.lit("concept_"), "label")), "concept", "embedding")
    near = c.select(F.col("concept").alias("c_src"), F.col("centre").alias("a")).crossJoin(c.select(F.col("concept").alias("c_tgt"), F.col("centre").alias("b"))).select("c_src", "c_tgt", cosine("a", "b").alias("cosine"))
    t = t.join(prior(t, *key), key, "left").join(near, ["c_src", "c_tgt"], "left")
    rows = cut(t.select(num("c_src").alias("c_src"), num("c_tgt").alias("c_tgt"), F.col("rst_type").alias("rel"), F.col("video_label").alias("label"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "prior"))
    fit_on = rows.where("label in (0, 1)").where(F.pmod(F.xxhash64("c_src", "c_tgt", "rel"), F.lit(100)) < 5).orderBy(F.xxhash64("c_src", "c_tgt", "rel", "label", "cosine"), "prior").limit(FIT_ROWS)  # a scorer is fitted on a bounded sample
    out = ml.triple_scorer(ml.fit_split(fit_on, "c_src", "rel", "c_tgt")[0], 64).transform(ml.triple_features(rows, 64))
    return out.groupBy("rel").agg(F.count("*").alias("n"), F.round(F.avg(vector_to_array("probability")[1]), 3).alias("score"))


def triple_scorer_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Rows fitted on, rows held out, and the share of these that the perceptron labels rightly."""
    t = table(spark, sf, "scored_candidates").where("c_src is not null and c_tgt is not null and rst_type is not null and video_label in (0, 1)")
    key, num = ["c_src", "rst_type", "c_tgt"], lambda c: F.regexp_extract(c, r"\d+", 0).cast("double")
    fit, held = ml.fit_split(t.where(F.pmod(F.xxhash64(*key), F.lit(100)) < 5).orderBy(F.xxhash64(*key, "video_id"), *key, "video_id").limit(FIT_ROWS), *key)
    rows = lambda df: df.join(prior(fit, *key), key, "left").select(num("c_src").alias("c_src"), num("c_tgt").alias("c_tgt"), F.col("rst_type").alias("rel"), F.col("video_label").cast("double").alias("label"), F.lit(0.0).alias("cosine"), "prior")
    fitted = cut(rows(fit))
    out = ml.triple_scorer(fitted, 64).transform(ml.triple_features(rows(held), 64))
    return out.agg(F.lit(fitted.count()).alias("fitted"), F.count("*").alias("held"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 3).alias("accuracy"))


QUERIES = {
    f.__name__: f
    for f in (
        transcript_gaps, stt_gap_boundaries, silence_runs, silence_boundaries, signal_spikes, signal_maxima, video_nodes, transcript_alignment, tree_to_links, tree_to_links_left, tree_to_spans, validated_videos, scene_index,
        table_counts, event_sessions, stream_new_videos, concept_kmeans, concept_mixture, cluster_diagnostics, cluster_silhouette, triple_scores, triple_scorer_accuracy,
    )
}
_SEGS = """
with recursive s as (select distinct on (video_id, scene_id) * from scenes order by video_id, scene_id, scene_no desc),
g as (select video_id, scene_id, unnest(range(1, least(len(start_s), len(end_s)) + 1)) as i, start_s, end_s from s),
t as (select video_id, scene_id, i, start_s[i] as a, end_s[i] as b from g where start_s[i] is not null and end_s[i] is not null),
p as (select video_id, a, lag(b) over (partition by video_id order by a, b, scene_id, i) as q from t)
"""
_SMOOTH = """
with recursive e as (select user_id, event_id, value from events where value is not null),
m as (select *, case when count(*) over (partition by user_id) >= {2} then sum(value) over (partition by user_id order by event_id rows between {0} preceding and {1} following) / {2} else value end as smooth from e)
"""
_APART = """, ap as (select user_id, min(event_id) as event_id from pts group by 1 union all select ap.user_id, (select min(p.event_id) from pts p where p.user_id = ap.user_id and p.event_id - ap.event_id >= 300) from ap where ap.event_id is not null)
"""
SQL = {
    "transcript_gaps": _SEGS + "select video_id, round((a + q) / 2, 4) as middle, round(a - q, 4) as gap from p where a - q >= 1.5",
    "stt_gap_boundaries": _SEGS + """, c as (select distinct video_id, (a + q) / 2 as m from p where a - q >= 1.5), k as (select video_id, min(m) as m from c group by 1
  union all select k.video_id, (select min(c.m) from c where c.video_id = k.video_id and c.m - k.m >= 1.5) from k where k.m is not null)
select video_id, round(m, 4) as boundary from k where m is not null""",
    "video_nodes": _SEGS + """, m as (select video_id, list_sort(list(distinct floor((a + q) / 2 * 1000) / 1000)) as b from p where a - q >= 1.0 group by 1),
v as (select video_id, d, coalesce([x for x in b if x > 1.5 and x < d - 1.5], []) as b, [round(i * d / 3, 3) for i in [1, 2]] as ev from (select video_id, max(b) as d from t group by 1) left join m using (video_id)),
k as (select *, list_reduce(b, lambda acc, x: case when len(acc) = 0 or x - acc[-1] >= 1.0 then list_append(acc, x) else acc end, []::double[]) as k from v),
f as (select *, [c for c in ev if c > 1.5 and c < d - 1.5 and len([x for x in k if abs(c - x) < 1.0]) = 0] as f from k),
o as (select *, list_sort(list_concat(k, list_reduce(f, lambda acc, x: case when len(acc) = 0 or x - acc[-1] >= 1.0 then list_append(acc, x) else acc end, []::double[]))) as mo from f),
c as (select video_id, list_concat(list_concat([0.0::double], [round(x, 3) for x in case when len(k) >= 2 then k when len(mo) >= 2 then mo else ev end]), [round(d, 3)]) as c from o)
select video_id, (i - 1)::int as node, c[i] as start, c[i + 1] as "end" from (select video_id, c, unnest(range(1, len(c))) as i from c)""",
    "silence_runs": """with e as (select user_id, event_id, value < 10.0 as q, row_number() over (partition by user_id order by event_id) as i from events where value is not null),
r as (select *, i - row_number() over (partition by user_id, q order by event_id) as run from e)
select user_id, min(event_id) as first, max(event_id) as last, count(*) as n from r where q group by user_id, run having count(*) >= 2""",
    "signal_spikes": _SMOOTH.format(5, 4, 10) + """, d as (select *, lead(smooth) over (partition by user_id order by event_id) - smooth as rise from m),
l as (select user_id, avg(rise) + 1.0 * stddev_pop(rise) as limit_ from d group by 1), pts as (select user_id, event_id, rise from d join l using (user_id) where rise > limit_)""" + _APART + """
select user_id, event_id, round(rise, 6) as rise from pts join ap using (user_id, event_id)""",
    "silence_boundaries": """with recursive e as (select user_id, event_id, value < 10.0 as q, row_number() over (partition by user_id order by event_id) as i from events where value is not null),
r as (select *, i - row_number() over (partition by user_id, q order by event_id) as run from e), c as (select *, count(*) over (partition by user_id, run) as n, row_number() over (partition by user_id, run order by event_id) - 1 as j from r where q),
pts as (select user_id, event_id from c where n >= 2 and j = n // 2)""" + _APART + "select user_id, event_id from ap where event_id is not null",
    "signal_maxima": _SMOOTH.format(2, 2, 5) + """, d as (select *, lag(smooth) over (partition by user_id order by event_id) as was, lead(smooth) over (partition by user_id order by event_id) as next from m),
l as (select user_id, avg(smooth) + 0.5 * stddev_pop(smooth) as limit_ from d group by 1),
pts as (select user_id, event_id, smooth from d join l using (user_id) where smooth > was and smooth >= next and smooth > limit_)""" + _APART + "select user_id, event_id, round(smooth, 6) as smooth from pts join ap using (user_id, event_id)",
    "tree_to_links": LINKS + """, r as (select video_id, lower(rel) as rel, row_number() over (partition by video_id order by link_pos) as i from k)
select video_id, i::int as src, i::int + 1 as tgt, coalesce(lag(rel) over (partition by video_id order by i), 'ROOT') as rel from r""",
    "tree_to_links_left": LINKS + """, r as (select video_id, row_number() over (partition by video_id order by link_pos) as i, count(*) over (partition by video_id) as n from k)
select video_id, 1::int as src, i::int + 1 as tgt, case when i = n then 'ROOT' else 'span' end as rel from r""",
    "tree_to_spans": LINKS + """, r as (select video_id, lower(rel) as rel, row_number() over (partition by video_id order by link_pos) as i, count(*) over (partition by video_id) as n from k)
select video_id, i::int as s, i::int as e, 'N' as nuc, 'span' as rel from r union all select video_id, n::int + 1, n::int + 1, 'S', max(rel) filter (i = n) from r group by 1, n
union all select video_id, i::int, n::int + 1, case when i = 1 then 'N' else 'S' end, coalesce(lag(rel) over (partition by video_id order by i), 'ROOT') from r""",
    "validated_videos": """with s as (select video_id, bool_or(scene_ids is not null) as listed, coalesce(max(video_label), -1) as label from video_samples group by 1)
select video_id, case when not listed then 'no scene list' when label < 0 then 'no label' when video_id not in (select video_id from scene_vectors where video_id is not null) then 'no vectors'
when video_id not in (select video_id from rst_links where video_id is not null) then 'no links' else 'ok' end as reason from s""",
    "scene_index": """with w as (select scene_uid, arg_max({'v': video_id, 's': scene_id, 'e': embedding}, written_at) as r from scene_vectors group by 1),
c as (select video_id, scene_id, arg_max(caption, scene_no) as caption from scenes group by 1, 2), y as (select video_id, max(video_label) as l from video_samples group by 1)
select scene_uid, r.v as video_id, r.s as scene_id, coalesce(l, -1) as video_label, coalesce(case when length(caption) > 990 then substr(caption, 1, 990) || '...' else caption end, '') as caption, len(r.e)::int as dim
from w left join c on c.video_id = r.v and c.scene_id = r.s left join y on y.video_id = r.v where r.e is not null""",
    "table_counts": " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("video_samples", "scenes", "rst_links", "scene_vectors")),
    "event_sessions": """with e as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minute, true)::int as new from events where ts is not null),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as "end", count(*) as n from s group by user_id, s""",
    "stream_new_videos": "select distinct video_id from video_samples",
    "cluster_diagnostics": "select count(*) as clusters, round(max(n) / sum(n)::double, 6) as largest_share, count(*) filter (n < 5) as tiny from (select label, count(*) as n from embeddings group by 1)",
}
