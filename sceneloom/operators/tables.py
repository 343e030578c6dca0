"""Keyed tables: upserts, merges, resumption, splits and distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one with the greatest ``order``; of equals the new one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    row = F.max_by(F.struct(*[c for c in both.columns if c not in ("_new", *keys)]), F.struct(order, "_new")).alias("_row")
    return both.groupBy(*keys).agg(row).select(*keys, "_row.*")


def merge_nodes(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``upsert`` of graph nodes: rows with a null in their key are no nodes; fields that the new row lacks keep their value."""
    known = " and ".join(f"{k} is not null" for k in keys)
    both = current.where(known).unionByName(new.where(known), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in both.columns if c not in keys))


def merge_edges(current: DataFrame, new: DataFrame, ends: list[str], kind: str) -> DataFrame:
    """Each edge (ends, kind) once, of both tables; edges without an end or a kind are none."""
    known = " and ".join(f"{c} is not null" for c in [*ends, kind])
    return current.select(*ends, kind).unionByName(new.select(*ends, kind)).where(known).distinct()


def add_labels(current: DataFrame, index: DataFrame, present: DataFrame, key: str, label: str) -> DataFrame:
    """The label map with what ``index``(key, label) says of keys that are ``present``; a pair that is there stays once, a key may stand under two labels."""
    rows = index.where(F.col(key).isNotNull() & F.col(label).isNotNull()).join(present.select(key).distinct(), key, "left_semi")
    return current.select(key, label).unionByName(rows.select(key, label)).distinct()


def add_keys(current: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The list of keys that were tried, with those of ``more``."""
    return current.select(key).unionByName(more.select(key)).where(F.col(key).isNotNull()).distinct()


def merge_fields(cache: DataFrame, update: DataFrame, keys: list[str], drop: tuple[str, ...] = ("error",)) -> DataFrame:
    """Fields of ``update`` over those of ``cache`` where they are not null; rows of either side stay; ``drop`` goes where a key was updated."""
    a, b = cache.withColumn("_a", F.lit(True)), update.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in update.columns if c not in keys], F.lit(True).alias("_b"))
    out = a.join(b, keys, "full")
    fields = [c for c in cache.columns if c not in keys] + [c for c in update.columns if c not in cache.columns]
    pick = []
    for c in fields:
        old = F.col(c) if c in cache.columns else F.lit(None)
        value = F.coalesce(f"_n_{c}", old) if c in update.columns else old
        pick.append((F.when(F.col("_b").isNull(), value) if c in drop else value).alias(c))
    return out.select(*keys, *pick)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def ranked(df: DataFrame, keys: list[str], order: Column, tie: str, buckets: int = 4096) -> DataFrame:
    """``rank`` (from 1) of each row within its keys by ``order``, a hex digest, ties by ``tie``.

    Rows are numbered inside (keys, leading digits of the digest) and shifted by the counts before, so a key that holds
    most rows is spread over ``buckets`` parts and none is sorted in one task.
    """
    digits = max(1, (buckets - 1).bit_length() // 4)
    d = df.withColumn("_d", order).withColumn("_b", F.substring("_d", 1, digits))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inside = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_d", tie)))
    return inside.join(before, [*keys, "_b"]).withColumn("rank", F.col("_r") + F.col("_before")).drop("_d", "_b", "_r", "_before")


def stratified_split(df: DataFrame, key: str, label: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``split`` train, val or test with exact shares within every label, in the order of a seeded digest of the key.

    Null labels are a stratum of their own (-1); repeated keys are one; a label with few rows fills train first.
    """
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.max(label), F.lit(-1)).alias(label))
    n = one.groupBy(label).agg(F.count("*").alias("_n"))
    r = ranked(one, [label], F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).join(F.broadcast(n), label)  # a row a label
    share = (F.col("rank") - 1) / F.col("_n")
    return r.select(key, label, F.when(share < train, "train").when(share < train + val, "val").otherwise("test").alias("split"))


def sample_seeded(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded digest of the key: the same ones whatever the partitioning."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)
