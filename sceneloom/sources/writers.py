"""Writers: tables with clustering, deletes, quarantine, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions.text import shorten
from sceneloom.operators.tables import upsert


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def create_table(df: DataFrame, path: str, partition: str | None = None, force: bool = False) -> bool:
    """Write a table unless it is there already (``force`` overwrites); a partition column takes the place of an inverted index."""
    if exists(df.sparkSession, path) and not force:
        return False
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)
    return True


def scene_index(scenes: DataFrame, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(scene_uid, vector, video_id, scene_id, video_label, caption): the rows of a scene collection, captions cut at 990; unknown labels are -1."""
    v = vectors.groupBy("scene_uid").agg(F.max_by(F.struct("video_id", "scene_id", "embedding"), "written_at").alias("v")).select("scene_uid", "v.*").where("embedding is not null")
    c = scenes.groupBy("video_id", "scene_id").agg(F.max_by("caption", "scene_no").alias("caption"))
    y = labels.groupBy("video_id").agg(F.max("video_label").alias("video_label"))
    return v.join(c, ["video_id", "scene_id"], "left").join(y, "video_id", "left").select(
        "scene_uid", F.col("embedding").alias("vector"), "video_id", "scene_id", F.coalesce("video_label", F.lit(-1)).alias("video_label"), F.coalesce(shorten("caption", 990), F.lit("")).alias("caption")
    )


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those deleted."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def important_only(scenes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept scenes (video_id, scene_id), and the edges (parent, child) both of whose ends are kept."""
    k = kept.select("video_id", "scene_id").distinct()
    ends = lambda c: k.withColumnRenamed("scene_id", c)
    return scenes.join(k, ["video_id", "scene_id"], "left_semi"), edges.join(ends("parent"), ["video_id", "parent"], "left_semi").join(ends("child"), ["video_id", "child"], "left_semi")


def quarantine(df: DataFrame, path: str, step: str) -> None:
    """Append (key, reason) rows to a failure log with the step and the time."""
    df.select("key", "reason", F.lit(step).alias("step"), F.current_timestamp().alias("at")).write.mode("append").json(path)


def append_csv(df: DataFrame, path: str, *scores: str) -> None:
    """Append a report; scores with four decimals."""
    df.select(*(F.format_string("%.4f", c).alias(c) if c in scores else c for c in df.columns)).write.mode("append").option("header", True).csv(path)


def save_concept_index(model, centres: DataFrame, priors: DataFrame, names: list[str], folder: str) -> None:
    """What ``readers.concept_index`` reads: the fitted pipeline, centres, priors and the relation vocabulary."""
    model.write().overwrite().save(f"{folder}/model")
    vocabulary = centres.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names)], "code int, rel string")
    for name, df in (("centres", centres), ("priors", priors), ("vocabulary", vocabulary)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_concepts(members: DataFrame, concepts: DataFrame, folder: str) -> None:
    """The tables ``concepts`` (a row each) and ``belongs_to`` (scene, concept), each row once."""
    concepts.dropDuplicates(["concept_id"]).write.mode("overwrite").parquet(f"{folder}/concepts")
    members.select("scene_uid", "concept_id").where("scene_uid is not null and concept_id is not null").distinct().write.mode("overwrite").parquet(f"{folder}/belongs_to")


def save_cache(df: DataFrame, path: str, keys: list[str], order: str) -> DataFrame:
    """Upsert rows into a cache table and return it; each call writes the next version, so a lost write leaves the last one whole."""
    spark = df.sparkSession
    done = spark.read.parquet(path).select(F.max("_v")).first()[0] if exists(spark, path) else None
    if done is not None:
        df = upsert(spark.read.parquet(path).where(F.col("_v") == done).drop("_v"), df, keys, order)
    version = (done or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/_v={version}")
    return spark.read.parquet(f"{path}/_v={version}")


def bracket_line(role: str, rel: str, first: str, last: str) -> Column:
    """A discourse span as ``((first, last), role, relation)``."""
    return F.format_string("((%d, %d), '%s', '%s')", F.col(first), F.col(last), F.col(role), F.col(rel))


def conll_line(*columns: str) -> Column:
    """A token row with tabs between its columns; nulls are underscores."""
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in columns))


def write_lines(df: DataFrame, line: str, path: str) -> None:
    df.select(line).write.mode("overwrite").text(path)
