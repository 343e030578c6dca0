"""Readers of a dataset's files: scene lists, labels, splits, transcripts, token rows, and checks of what is complete."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE = (
    "start array<double>, end array<double>, text array<string>, speaker array<string>, clip_path string, visual_description string, "
    "visual_elements map<string,string>, caption string, audio_tags array<string>, audio_vibes array<string>"
)
SEGMENT = "start double, end double, text string, speaker string"
TOKEN = "doc string, sent int, tok int, word string, lemma string, pos string, dep string, head int, ner string"


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, folder, length, modified) of the files of a glob, without their contents."""
    f = spark.read.format("binaryFile").load(pattern).select("path", "length", F.col("modificationTime").alias("modified"))
    return f.withColumn("folder", folder_of("path"))


def folder_of(path: str | Column) -> Column:
    return F.element_at(F.split(F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/"), "/"), -2)


def unprocessed(found: DataFrame, done: DataFrame, key: str = "folder") -> DataFrame:
    """Files of folders that ``done`` does not list and that are not empty."""
    return found.where("length > 0").join(done.select(key).distinct(), key, "left_anti")


def whole_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(folder, body): one row a file."""
    return spark.read.text(pattern, wholetext=True).select(folder_of(F.col("_metadata.file_path")).alias("folder"), F.col("value").alias("body"))


def scene_files(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(scenes, rejected) of scene files in either form: a list, numbered by position, or an object keyed by scene number.

    scenes: video_id, scene_id and the fields of SCENE; rejected: folder, reason. Keys that are no numbers and files that cannot be read are rejected.
    """
    raw = whole_files(spark, pattern)
    body = F.trim("body")
    listed, keyed = F.from_json("body", f"array<struct<{SCENE}>>"), F.from_json("body", f"map<string,struct<{SCENE}>>")
    sound = F.try_parse_json("body").isNotNull()
    lists = raw.where(sound & body.startswith("[")).select(F.col("folder").alias("video_id"), F.posexplode(listed).alias("scene_id", "s"))
    maps = raw.where(sound & body.startswith("{")).select(F.col("folder").alias("video_id"), F.explode(keyed).alias("k", "s"))
    bad_keys = maps.where(~F.col("k").rlike(r"^\d+$")).select(F.col("video_id").alias("folder"), F.concat(F.lit("scene key "), "k").alias("reason"))
    good = maps.where(F.col("k").rlike(r"^\d+$")).select("video_id", F.col("k").cast("int").alias("scene_id"), "s")
    rejected = raw.where(~sound | ~(body.startswith("[") | body.startswith("{"))).select("folder", F.lit("not a list or object").alias("reason"))
    return lists.unionByName(good).select("video_id", "scene_id", "s.*"), rejected.unionByName(bad_keys)


def transcript_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(video_id, seg, start, end, text, speaker) of transcripts as a list, or as an object with ``segments`` and then without speakers."""
    raw = whole_files(spark, pattern)
    rows = F.coalesce(F.from_json("body", f"struct<segments:array<struct<{SEGMENT}>>>")["segments"], F.from_json("body", f"array<struct<{SEGMENT}>>"))
    return raw.select(F.col("folder").alias("video_id"), F.posexplode(rows).alias("seg", "s")).select("video_id", "seg", "s.*")


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, label) of {label: [ids]} or {id: label}; an id with .mp4 is listed without it too."""
    raw = spark.read.text(path, wholetext=True)
    by_label = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("label", "ids")).select(F.explode("ids").alias("video_id"), F.col("label").try_cast("int").alias("label"))
    by_id = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("video_id", "v")).select("video_id", F.col("v").try_cast("int").alias("label"))
    both = by_label.unionByName(by_id).where("label is not null")
    alias = both.where("video_id like '%.mp4'").select(F.regexp_replace("video_id", r"\.mp4$", "").alias("video_id"), "label")
    return both.unionByName(alias).groupBy("video_id").agg(F.max("label").alias("label"))


def resolve_labels(videos: DataFrame, labels: DataFrame) -> DataFrame:
    """``label`` of each (video_id, file_name): by id, else by file name, else by its stem, else -1."""
    named = lambda c: labels.select(F.col("video_id").alias(c), F.col("label").alias(f"_{c}"))
    v = videos.withColumn("stem", F.regexp_replace("file_name", r"\.[^.]*$", ""))
    for c in ("video_id", "file_name", "stem"):
        v = v.join(named(c), c, "left")
    return v.withColumn("label", F.coalesce("_video_id", "_file_name", "_stem", F.lit(-1))).drop("_video_id", "_file_name", "_stem", "stem")


def splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, video_id) of {split: [ids]}."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("split", "ids"))
    return raw.select("split", F.explode("ids").alias("video_id")).distinct()


def csv_index(spark: SparkSession, path: str, *ignore: DataFrame) -> DataFrame:
    """(video_id, video_link, engagement_rate_label) of a CSV index, without the ids of each ``ignore(video_id)``."""
    df = spark.read.csv(path, header=True, schema="video_id string, video_link string, engagement_rate_label int")
    for other in ignore:
        df = df.join(other.select("video_id").distinct(), "video_id", "left_anti")
    return df


def or_empty(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table, or an empty one if it is not there; of JSON, ``json_records`` gives the records that can't be read."""
    try:
        df = json_records(spark, path, schema)[0] if kind == "json" else spark.read.schema(schema).format(kind).load(path)
        df.isEmpty()
        return df
    except AnalysisException:
        return spark.createDataFrame([], schema)


def json_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected(key, reason)) of a JSON-lines file: a line that is no JSON object of the schema is rejected with its text, not dropped."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    doc = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = raw.select("value", doc.alias("d"))
    bad = F.col("d").isNull() | F.col("d._bad").isNotNull()
    names = [f.name for f in rows.schema["d"].dataType.fields if f.name != "_bad"]
    return rows.where(~bad).select(*(F.col(f"d.{n}").alias(n) for n in names)), rows.where(bad).select(F.col("value").alias("key"), F.lit("malformed record").alias("reason"))


def video_records(scenes: DataFrame, vectors: DataFrame, links: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scene rows of complete videos, rejected(key, reason)): scenes with vector and caption, and the video's number of links.

    Only the latest vector of a scene counts. A video without a scene list, a label, a vector or a link is rejected as
    ``checked_videos`` says; so is each scene whose vector is null, all zero or not finite.
    """
    checked = checked_videos(samples, vectors, links)
    good = checked.where("reason = 'ok'").select("video_id")
    v = vectors.groupBy("video_id", "scene_id").agg(F.max_by("embedding", "written_at").alias("embedding"))
    x = F.col("embedding")
    sound = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0), F.lit(False))
    v = v.join(good, "video_id", "left_semi").withColumn("sound", sound)
    c = scenes.groupBy("video_id", "scene_id").agg(F.max_by("caption", "scene_no").alias("caption"))
    n = links.select("video_id", "link_pos").distinct().groupBy("video_id").agg(F.count("*").alias("links"))
    rows = v.where("sound").drop("sound").join(c, ["video_id", "scene_id"], "left").join(n, "video_id", "left")
    bad = checked.where("reason <> 'ok'").select(F.col("video_id").alias("key"), "reason")
    return rows, bad.unionByName(v.where("not sound").select(F.concat_ws("_scene_", "video_id", F.col("scene_id").cast("string")).alias("key"), F.lit("unusable vector").alias("reason")))


def scene_guard(videos: DataFrame, units: str | Column, captions: str | Column, least: int = 2) -> DataFrame:
    """``reason`` for arrays of a video's text units and captions: 'ok', too few units, fewer captions than units, or an empty caption."""
    u, c = (F.col(x) if isinstance(x, str) else x for x in (units, captions))
    reason = (
        F.when(F.coalesce(F.size(u), F.lit(0)) < least, "too few units").when(F.coalesce(F.size(c), F.lit(0)) < F.size(u), "too few captions")
        .when(F.exists(c, lambda x: x.isNull() | (F.trim(x) == "")), "empty caption").otherwise("ok")
    )
    return videos.withColumn("reason", reason)


def concept_index(spark: SparkSession, folder: str, vocabulary: int) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model, centres, priors) of a written concept index; an error if it was built over another number of relation types."""
    model, centres, priors, names = PipelineModel.load(f"{folder}/model"), *(spark.read.parquet(f"{folder}/{t}") for t in ("centres", "priors", "vocabulary"))
    if (n := names.count()) != vocabulary:
        raise ValueError(f"the concept index has {n} relation types, not {vocabulary}")
    return model, centres, priors


def edu_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc, edu, text) of files with one text unit a line, numbered from 1; blank lines are no units. A file's lines stay together, as one file is one row."""
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    raw = spark.read.text(pattern, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc"), F.posexplode(lines).alias("i", "text"))
    return raw.select("doc", (F.col("i") + 1).alias("edu"), "text")


def checked_videos(samples: DataFrame, vectors: DataFrame, links: DataFrame) -> DataFrame:
    """(video_id, reason): 'ok', or the first thing that a video lacks: scene list, label, vectors, links."""
    has = lambda df, c: df.select("video_id").distinct().withColumn(c, F.lit(True))
    v = samples.groupBy("video_id").agg(F.max(F.col("scene_ids").isNotNull()).alias("listed"), F.max("video_label").alias("label"))
    v = v.join(has(vectors, "vectors"), "video_id", "left").join(has(links, "links"), "video_id", "left")
    reason = (
        F.when(~F.col("listed"), "no scene list").when(F.coalesce("label", F.lit(-1)) < 0, "no label")
        .when(F.col("vectors").isNull(), "no vectors").when(F.col("links").isNull(), "no links").otherwise("ok")
    )
    return v.select("video_id", reason.alias("reason"))


def token_rows(spark: SparkSession, pattern: str, strict: bool = True) -> DataFrame:
    """Token rows of tab-separated CoNLL files (eight columns or more); blank lines are none, and a shorter row is an error, or left out if not ``strict``."""
    t = F.split("value", "\t")
    raw = spark.read.text(pattern).where("trim(value) <> ''").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc"), t.alias("t"))
    at = lambda i: F.get("t", F.lit(i))
    short = F.assert_true(F.size("t") >= 8, F.concat(F.lit("fewer than eight columns in "), "doc"))
    raw = raw.withColumn("_short", short).where("_short is null") if strict else raw
    return raw.where("size(t) >= 8").select(
        "doc", at(0).try_cast("int").alias("sent"), at(1).try_cast("int").alias("tok"), *(at(i).alias(n) for i, n in ((2, "word"), (3, "lemma"), (4, "pos"), (5, "dep"))),
        at(6).try_cast("int").alias("head"), at(7).alias("ner"),
    )


def unreadable_xml(spark: SparkSession, pattern: str) -> DataFrame:
    """(key, reason) of the parser XML files that ``xml_token_rows`` has no rows of because they cannot be read."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            bad = []
            for doc, body in zip(pdf["folder"], pdf["body"]):
                try:
                    ET.fromstring(body)
                except ET.ParseError as e:
                    bad.append((doc, str(e)))
            yield pd.DataFrame(bad, columns=["key", "reason"])

    return whole_files(spark, pattern).mapInPandas(read, "key string, reason string")


def xml_token_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """Token rows of parser XML: sentences with tokens, and the basic dependency of each token. ``unreadable_xml`` names the files left out."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for doc, body in zip(pdf["folder"], pdf["body"]):
                try:
                    top = ET.fromstring(body)
                except ET.ParseError:
                    continue
                for s, sent in enumerate(top.iter("sentence")):
                    if sent.find("tokens") is None:
                        continue
                    deps = {}
                    for d in sent.iter("dependencies"):
                        if d.get("type") in (None, "basic-dependencies"):
                            deps = {int(x.find("dependent").get("idx")): (x.get("type"), int(x.find("governor").get("idx"))) for x in d.iter("dep")}
                            break
                    for tok in sent.find("tokens").iter("token"):
                        i = int(tok.get("id"))
                        rows.append((doc, s, i, *(tok.findtext(n) for n in ("word", "lemma", "POS")), *deps.get(i, (None, None)), tok.findtext("NER")))
            yield pd.DataFrame(rows, columns=["doc", "sent", "tok", "word", "lemma", "pos", "dep", "head", "ner"]).astype({"head": "Int32"})

    return whole_files(spark, pattern).mapInPandas(read, TOKEN)
