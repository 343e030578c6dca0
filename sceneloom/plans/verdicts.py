"""Queries of texts, verdicts, ensembles, evaluation and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions import text as tx
from sceneloom.functions.captions import normal_caption
from sceneloom.operators import ensemble as en
from sceneloom.operators import tables as tb
from sceneloom.runtime import table


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "predictions").dropDuplicates(["record_no"])


def _leans() -> dict[str, tuple]:
    return {c: (F.col(f"{c}_lean"), F.col(f"{c}_confidence")) for c in ("content", "narrative", "graph")}


def ensemble_three_vote(spark: SparkSession, sf: str) -> DataFrame:
    c = _leans()
    return _predictions(spark, sf).select("record_no", en.ensemble(F.col("predicted_label"), c["content"], c["narrative"]).alias("label"))


def ensemble_two_signal(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).select("record_no", en.ensemble(F.col("predicted_label"), _leans()["graph"]).alias("label"))


def ensemble_full(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).select("record_no", en.ensemble(F.col("predicted_label"), *_leans().values()).alias("label"))


def ensemble_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).select("record_no", "evidence_mode", en.final_label(F.col("evidence_mode"), F.col("predicted_label"), *_leans().values()).alias("label"))


def prediction_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    a = en.accuracy(_predictions(spark, sf), "ground_truth", "predicted_label", "final_prediction")
    return a.withColumn("accuracy", F.round("accuracy", 6))


def lean_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    a = en.lean_accuracy(_predictions(spark, sf), "ground_truth", content="content_lean", narrative="narrative_lean", graph="graph_lean")
    return a.withColumn("accuracy", F.round("accuracy", 6))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return en.confusion(_predictions(spark, sf), "ground_truth", "final_prediction")


def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = en.class_metrics(_predictions(spark, sf), "ground_truth", "final_prediction")
    return m.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def evidence_majority(spark: SparkSession, sf: str) -> DataFrame:
    pos, neg = (F.count_if(F.col("video_label") == x) for x in (2, 0))
    return table(spark, sf, "similarity_videos").groupBy("query_video_id").agg(en.majority(pos, neg).alias("lean"))


def verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).select("record_no", tx.verdict("raw_llm_output").alias("v")).select("record_no", "v.*")


def caption_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scenes").dropDuplicates(["scene_no"]).select("scene_no", tx.shorten("caption", 130).alias("caption"))


def caption_normal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scenes").dropDuplicates(["scene_no"]).select("scene_no", normal_caption("caption").alias("caption"))


def uid_parts(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "scene_vectors").select("scene_uid", "video_id", "scene_id").distinct()
    return v.select("scene_uid", tx.scene_of_uid("scene_uid").alias("scene_no"), (tx.scene_uid("video_id", "scene_id") == F.col("scene_uid")).alias("same"))


def caption_timecodes(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scenes").dropDuplicates(["scene_no"])
    t = F.regexp_extract("caption", r"(\d{2}:\d{2})", 1)
    return s.where(t != "").select("scene_no", t.alias("timecode"), tx.timecode_seconds(t).alias("seconds"), tx.first_number("caption").alias("first_number"))


def scene_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scenes").dropDuplicates(["scene_no"])
    a, b = tx.span_start("start_s"), tx.span_end("end_s")
    return s.select("scene_no", F.round(a, 3).alias("start"), F.round(b, 3).alias("end"), F.round(tx.clip_length(b - a), 4).alias("clip"))


def speaker_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each scene's segments as lines of speaker and start; the lists may differ in length."""
    s = table(spark, sf, "scenes").dropDuplicates(["scene_no"])
    at = F.transform("start_s", lambda x: F.format_string("%.3f", x))
    return s.select("scene_no", tx.spoken_lines("speaker", at, " / ").alias("lines"), F.array_join(tx.fit("speaker", F.size("start_s"), "?"), "|").alias("speakers"))


def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scenes").dropDuplicates(["scene_no"])
    said = tx.spoken_lines("speaker", F.transform("start_s", lambda x: F.format_string("%.3f", x)))
    looks = {"mood": F.lower(F.trim("split")), "background": F.col("source")}
    return s.select("scene_no", tx.embedding_text(said, F.col("caption"), looks, F.col("audio_tags"), F.slice("audio_tags", 1, 1)).alias("text"))


def dominant_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Each candidate's label counts as JSON, read back for the dominant one."""
    n = table(spark, sf, "similarity_videos").where("video_label is not null").groupBy("query_video_id", "video_label").agg(F.count("*").alias("n"))
    j = n.groupBy("query_video_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("video_label").cast("string"), F.col("n").cast("int")))))).alias("distribution"))
    return j.select("query_video_id", "distribution", tx.dominant_label("distribution").alias("d")).select("query_video_id", "distribution", "d.*")


def token_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("token_count")
    return _predictions(spark, sf).groupBy("evidence_mode").agg(F.min(t).alias("least"), F.max(t).alias("most"), F.round(F.avg(t), 4).alias("mean"), F.count_if(t > 512).alias("over"))


def prompt_overflow(spark: SparkSession, sf: str) -> DataFrame:
    """What is cut where a prompt is too long: graph, then narrative, then content, whichever is there."""
    over = F.col("token_count") > 512
    cut = F.when(over & F.col("graph_lean").isNotNull(), "graph").when(over & F.col("narrative_lean").isNotNull(), "narrative").when(over & F.col("content_lean").isNotNull(), "content").otherwise("nothing")
    return _predictions(spark, sf).groupBy(cut.alias("cut")).agg(F.count("*").alias("n"))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "video_samples").select(tx.canonical_video_id("video_id").alias("video_id"), "video_label")
    return tb.stratified_split(s, "video_id", "video_label")


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)


def stratified_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).groupBy("video_label", "split").agg(F.count("*").alias("n"))


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return tb.sample_seeded(table(spark, sf, "predictions").select("record_no").distinct(), "record_no", 20)


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Scene vectors written before 2025, upserted with the later ones."""
    v = table(spark, sf, "scene_vectors").select("scene_uid", "scene_idx", "written_at")
    return tb.upsert(v.where("written_at < timestamp '2025-01-01'"), v.where("written_at >= timestamp '2025-01-01'"), ["scene_uid"], "written_at").select("scene_uid", "scene_idx", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss").alias("written_at"))


def cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by video as the cache, leans as the update, verdict errors dropped where updated."""
    p = _predictions(spark, sf)
    cache = p.groupBy("folder_name").agg(F.max("predicted_label").alias("label"), F.max(F.when(F.col("raw_llm_output").isNull(), "no output")).alias("error"))
    update = p.where("content_lean is not null").groupBy("folder_name").agg(F.max("content_lean").alias("lean"), F.max("final_prediction").alias("label"))
    return tb.merge_fields(cache, update, ["folder_name"])


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "video_samples").select(tx.canonical_video_id("video_id").alias("video_id")).distinct()
    return tb.remaining(s, table(spark, sf, "predictions").select(F.col("folder_name").alias("video_id")), "video_id")


def train_val_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "video_samples").select(tx.canonical_video_id("video_id").alias("video_id"), tx.split_name("split").alias("split"))
    return s.where("split = 'train'").select("video_id").union(s.where("split = 'val'").select("video_id")).distinct()


_P = "(select distinct on (record_no) * from predictions)"


def _vote_sql(*channels: str) -> str:
    votes = ["predicted_label", *(f"{c}_lean" for c in channels)]
    ok = "[x for x in [" + ", ".join(votes) + "] if x in (0, 1, 2)]"
    strong = ", ".join(f"case when {c}_confidence = 'strong' and {c}_lean in (0, 1, 2) then {c}_lean end" for c in channels)
    firsts = ", ".join(f"case when {v} in (0, 1, 2) then {v} end" for v in votes)
    n = [f"len([x for x in {ok} if x = {k}])" for k in (0, 1, 2)]
    most = f"greatest({', '.join(n)})"
    lead = " + ".join(f"({x} = {most})::int" for x in n)
    return f"case when {most} = 0 then -1 when {lead} > 1 then coalesce({strong + ', ' if strong else ''}{firsts}) when {n[0]} = {most} then 0 when {n[1]} = {most} then 1 else 2 end"


_JSON = r"""
with t as (select record_no, raw_llm_output as raw, trim(regexp_replace(regexp_replace(trim(raw_llm_output, e' \n\t'), '^```(json)?\s*', '', 'i'), '\s*```$', '')) as t from (select distinct on (record_no) * from predictions)),
b as (select *, regexp_extract(t, '\{.*\}', 0, 's') as b from t), j as (select *, case when b <> '' and json_valid(b) then b end as j from b),
s as (select *, trim(json_extract_string(j, '$.predicted_label')) as s, regexp_extract(t, '(predicted[-_ ]label|label|prediction)\s*["'']?\s*[:=]\s*["'']?\s*(\d+)', 2, 'i') as l from j),
n as (select *, case when regexp_matches(s, '^[+-]?\d+$') then s::int end as n, case when l <> '' then l::int end as m from s)
"""
_SNAP = "least(greatest({}, 0), 2)"
_SPLIT = r"""
with s as (select case when regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) <> '' then regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) else trim(video_id) end as video_id, video_label, split from video_samples),
o as (select video_id, coalesce(max(video_label), -1) as video_label from s where video_id is not null group by 1),
r as (select *, (row_number() over (partition by video_label order by md5(video_id || ':42'), video_id) - 1) / count(*) over (partition by video_label)::double as f from o),
z as (select video_id, video_label, case when f < 0.8 then 'train' when f < 0.8 + 0.1 then 'val' else 'test' end as split from r)
"""
QUERIES = {
    f.__name__: f
    for f in (
        ensemble_three_vote, ensemble_two_signal, ensemble_full, ensemble_by_mode, prediction_accuracy, lean_accuracy, confusion_matrix, confusion_metrics, evidence_majority, verdict_parse,
        caption_truncate, caption_normal, uid_parts, caption_timecodes, scene_spans, speaker_lines, embedding_text, dominant_labels, token_length_stats, prompt_overflow, stratified_split,
        stratified_split_counts, seeded_sample, upsert_latest, cache_merge, resume_antijoin, train_val_ids,
    )
}
_S = "(select distinct on (scene_no) * from scenes)"
SQL = {
    "ensemble_three_vote": f"select record_no, {_vote_sql('content', 'narrative')} as label from {_P}",
    "ensemble_two_signal": f"select record_no, {_vote_sql('graph')} as label from {_P}",
    "ensemble_full": f"select record_no, {_vote_sql('content', 'narrative', 'graph')} as label from {_P}",
    "ensemble_by_mode": f"""select record_no, evidence_mode, case evidence_mode when 'full' then {_vote_sql('content', 'narrative', 'graph')} when 'milvus' then {_vote_sql('content', 'narrative')}
when 'graph' then {_vote_sql('graph')} else {_vote_sql()} end as label from {_P}""",
    "prediction_accuracy": " union all ".join(
        f"select '{c}' as prediction, count(*) as rows, round(avg(case when {c} = ground_truth then 1.0::double else 0 end), 6) as accuracy from {_P} where ground_truth is not null" for c in ("predicted_label", "final_prediction")
    ),
    "lean_accuracy": " union all ".join(
        f"select '{c}' as channel, count({c}_lean) as decided, count(*) - count({c}_lean) as undecided, round(avg(case when {c}_lean = ground_truth then 1.0::double when {c}_lean is not null then 0 end), 6) as accuracy from {_P} where ground_truth is not null"
        for c in ("content", "narrative", "graph")
    ),
    "confusion_matrix": f"select ground_truth, final_prediction, count(*) as n from {_P} where ground_truth is not null group by 1, 2",
    "confusion_metrics": f"""with p as (select ground_truth as t, final_prediction as p from {_P} where ground_truth is not null and final_prediction is not null),
l as (select distinct t as label from p union select p from p), c as (select label, count(*) filter (t = label and p = label) as h, count(*) filter (p = label) as s, count(*) filter (t = label) as n from l, p group by 1)
select label, round(case when s > 0 then h / s::double else 0 end, 6) as precision, round(case when n > 0 then h / n::double else 0 end, 6) as recall, round(2 * h / (s + n)::double, 6) as f1, n as support from c""",
    "evidence_majority": """select query_video_id, case when count(*) filter (video_label = 2) > count(*) filter (video_label = 0) then 'engaging'
when count(*) filter (video_label = 2) < count(*) filter (video_label = 0) then 'not_engaging' else 'mixed' end as lean from similarity_videos group by 1""",
    "verdict_parse": _JSON + f"""select record_no, case when raw is null or raw = '' then -1 when n is not null then {_SNAP.format('n')} when m is not null then {_SNAP.format('m')} else -1 end as predicted_label,
case when raw is null or raw = '' then 'Empty LLM response' when n is not null then json_extract_string(j, '$.explanation') when m is not null then 'Broad Regex' else 'Parsing failed' end as explanation from n""",
    "caption_truncate": f"select scene_no, case when length(caption) > 130 then substr(caption, 1, 130) || '...' else caption end as caption from {_S}",
    "caption_normal": rf"""select scene_no, coalesce(trim(regexp_replace(regexp_replace(replace(strip_accents(lower(regexp_replace(replace(replace(replace(caption, '…', '...'), chr(160), ' '), 'đ', 'd'), '[“”‘’—–£€¥₹¤±©®™]', '', 'g'))), 'đ', 'd'),
'([,.;:!?()"''/\\-])', ' \1 ', 'g'), '\s+', ' ', 'g')), '') as caption from {_S}""",
    "uid_parts": r"select distinct scene_uid, regexp_extract(scene_uid, '_(\d+)$', 1)::int as scene_no, scene_uid = video_id || '_scene_' || scene_id as same from scene_vectors",
    "caption_timecodes": rf"""select scene_no, t as timecode, split_part(t, ':', 1)::double * 60 + split_part(t, ':', 2)::double as seconds, regexp_extract(caption, '\d+')::bigint as first_number
from (select *, regexp_extract(caption, '(\d{{2}}:\d{{2}})', 1) as t from {_S}) where t <> ''""",
    "scene_spans": f"""select scene_no, round(start_s[1], 3) as start, round(end_s[-1], 3) as "end", round(greatest(0.8, least(3.0, 0.08 * (end_s[-1] - start_s[1]))), 4) as clip from {_S}""",
    "speaker_lines": f"""select scene_no, coalesce(array_to_string([speaker[i] || ': ' || printf('%.3f', start_s[i]) for i in range(1, least(len(speaker), len(start_s)) + 1) if speaker[i] is not null], ' / '), '') as lines,
array_to_string([case when i <= coalesce(len(speaker), 0) then speaker[i] else '?' end for i in range(1, len(start_s) + 1)], '|') as speakers from {_S}""",
    "embedding_text": f"""select scene_no, concat_ws(chr(10), 'Transcript:', coalesce(nullif(array_to_string([speaker[i] || ': ' || printf('%.3f', start_s[i]) for i in range(1, least(len(speaker), len(start_s)) + 1) if speaker[i] is not null], chr(10)), ''), '(no spoken dialogue)'),
'Caption:', coalesce(caption, '(no caption)'), 'Mood: ' || coalesce(lower(trim(split, ' ')), 'neutral'), 'Lighting: unknown', 'Background: ' || coalesce(source, 'unknown'),
'Color temperature: unknown', 'Color saturation: medium', 'Color lightness: medium', 'Tags: ' || case when len(audio_tags) > 0 then array_to_string(audio_tags, ', ') else 'none' end, 'Vibes: ' || case when len(audio_tags) > 0 then audio_tags[1] else 'none' end) as text from {_S}""",
    "dominant_labels": """with n as (select query_video_id, video_label as l, count(*) as n from similarity_videos where video_label is not null group by 1, 2)
select query_video_id, '{' || string_agg('"' || l || '":' || n, ',' order by l::varchar) || '}' as distribution, arg_max(l, n * 100 - l) as label, max(n)::int as count, sum(n)::int as total from n group by 1""",
    "token_length_stats": f"select evidence_mode, min(token_count) as least, max(token_count) as most, round(avg(token_count), 4) as mean, count(*) filter (token_count > 512) as over from {_P} group by 1",
    "prompt_overflow": f"""select case when token_count > 512 and graph_lean is not null then 'graph' when token_count > 512 and narrative_lean is not null then 'narrative'
when token_count > 512 and content_lean is not null then 'content' else 'nothing' end as cut, count(*) as n from {_P} group by 1""",
    "stratified_split": _SPLIT + "select * from z",
    "stratified_split_counts": _SPLIT + "select video_label, split, count(*) as n from z group by 1, 2",
    "seeded_sample": "select record_no from (select distinct record_no from predictions) order by md5(record_no || ':42'), record_no limit 20",
    "upsert_latest": "select scene_uid, arg_max(scene_idx, written_at) as scene_idx, strftime(max(written_at), '%Y-%m-%d %H:%M:%S') as written_at from scene_vectors group by 1",
    "cache_merge": f"""with p as (select * from {_P}), u as (select folder_name, max(content_lean) as lean, max(final_prediction) as label from p where content_lean is not null group by 1),
c as (select folder_name, max(predicted_label) as label, max(case when raw_llm_output is null then 'no output' end) as error from p group by 1)
select folder_name, coalesce(u.label, c.label) as label, case when u.folder_name is null then error end as error, lean from c full join u using (folder_name)""",
    "resume_antijoin": _SPLIT + "select distinct video_id from s where video_id not in (select folder_name from predictions where folder_name is not null)",
    "train_val_ids": _SPLIT + "select distinct video_id from s where lower(trim(split)) in ('train', 'training', 'val', 'validation')",
}
