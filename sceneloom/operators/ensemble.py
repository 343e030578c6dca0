"""Votes of a verdict and of evidence channels combined into one label, and measures of the outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = (0, 1, 2)


def ensemble(llm: Column, *channels: tuple[Column, Column], labels: tuple[int, ...] = LABELS, first_only: bool = False) -> Column:
    """The label with most valid votes of the verdict and the channels, each (lean, confidence).

    If two labels lead: the first channel with a strong valid lean, else the verdict if valid, else the first valid
    lean, or with ``first_only`` the first channel's lean whatever it is. -1 without any valid vote.
    """
    valid = lambda c: F.when(c.isin(*labels), c)
    cast = [valid(llm), *(valid(lean) for lean, _ in channels)]
    n = {x: reduce(lambda a, b: a + b, (F.when(v == x, 1).otherwise(0) for v in cast)) for x in labels}
    most = F.greatest(*n.values())
    leaders = reduce(lambda a, b: a + b, (F.when(c == most, 1).otherwise(0) for c in n.values()))
    winner = reduce(lambda w, x: w.when(n[x] == most, x), labels[1:], F.when(n[labels[0]] == most, labels[0]))
    strong = [F.when(conf == "strong", valid(lean)) for lean, conf in channels]
    tie = F.coalesce(*strong, cast[0], channels[0][0]) if first_only and channels else F.coalesce(*strong, *cast)
    return F.when(most == 0, -1).when(leaders > 1, tie).otherwise(winner)


def final_label(mode: Column, llm: Column, content: tuple[Column, Column], narrative: tuple[Column, Column], graph: tuple[Column, Column]) -> Column:
    """Which channels vote depends on the evidence mode; in other modes the verdict alone does."""
    return (
        F.when(mode == "full", ensemble(llm, content, narrative, graph))
        .when(mode == "milvus", ensemble(llm, content, narrative))
        .when(mode == "graph", ensemble(llm, graph))
        .otherwise(ensemble(llm))
    )


def majority(positive: Column, negative: Column) -> Column:
    return F.when(positive > negative, "engaging").when(positive < negative, "not_engaging").otherwise("mixed")


def accuracy(df: DataFrame, truth: str, *predictions: str) -> DataFrame:
    """(prediction, rows, accuracy) over rows with a known truth."""
    rows = df.where(F.col(truth).isNotNull())
    each = F.inline(F.array(*(F.struct(F.lit(p).alias("prediction"), F.col(p).alias("p")) for p in predictions)))
    hit = F.when(F.col("p") == F.col(truth), 1.0).otherwise(0.0)
    return rows.select(truth, each).groupBy("prediction").agg(F.count("*").alias("rows"), F.avg(hit).alias("accuracy"))


def lean_accuracy(df: DataFrame, truth: str, **leans: str) -> DataFrame:
    """(channel, decided, undecided, accuracy): a lean without a label is no decision and counts for neither side."""
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("channel"), F.col(c).alias("lean")) for k, c in leans.items())))
    rows = df.where(F.col(truth).isNotNull()).select(truth, each)
    hit = F.when(F.col("lean") == F.col(truth), 1.0).when(F.col("lean").isNotNull(), 0.0)
    return rows.groupBy("channel").agg(F.count("lean").alias("decided"), F.count_if(F.col("lean").isNull()).alias("undecided"), F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull()).groupBy(truth, prediction).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support) from the confusion counts; 0 where nothing can be divided."""
    c = confusion(df, truth, prediction).where(F.col(prediction).isNotNull())
    t = c.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"))
    p = c.groupBy(F.col(prediction).alias("label")).agg(F.sum("n").alias("said"))
    h = c.where(F.col(truth) == F.col(prediction)).select(F.col(truth).alias("label"), F.col("n").alias("hit"))
    m = t.join(p, "label", "full").join(h, "label", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr, rc = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    return m.select("label", pr.alias("precision"), rc.alias("recall"), ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")
