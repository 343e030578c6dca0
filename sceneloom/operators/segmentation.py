"""Cutting videos into scenes: gaps, silences, spikes and maxima of signals, boundary merging, transcript alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(scenes: DataFrame) -> DataFrame:
    """(video_id, scene_id, seg, start, end, speaker): a row for each transcript segment; a missing speaker is null."""
    one = scenes.groupBy("video_id", "scene_id").agg(F.max_by(F.struct("start_s", "end_s", "speaker"), "scene_no").alias("s"))
    rows = one.select("video_id", "scene_id", F.posexplode(F.arrays_zip("s.start_s", "s.end_s")).alias("seg", "t"), F.col("s.speaker").alias("sp"))
    return rows.select("video_id", "scene_id", "seg", F.col("t.start_s").alias("start"), F.col("t.end_s").alias("end"), F.get("sp", F.col("seg")).alias("speaker")).where("start is not null and end is not null")


def gaps(segs: DataFrame, least: float = 1.5) -> DataFrame:
    """(video_id, middle, gap): pauses of ``least`` seconds or more between consecutive segments."""
    w = Window.partitionBy("video_id").orderBy("start", "end", "scene_id", "seg")
    g = segs.withColumn("before", F.lag("end").over(w)).withColumn("gap", F.col("start") - F.col("before"))
    return g.where(F.col("gap") >= least).select("video_id", ((F.col("start") + F.col("before")) / 2).alias("middle"), "gap")


def spaced(points: str | Column, gap: float) -> Column:
    """Of rising points those at least ``gap`` after the last one kept; the first is always kept."""
    p = F.array_sort(F.array_distinct(F.col(points) if isinstance(points, str) else points))
    keep = lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= gap), F.concat(kept, F.array(x))).otherwise(kept)
    return F.aggregate(p, F.slice(p, 1, 1), lambda kept, x: F.when(x == F.element_at(kept, 1), kept).otherwise(keep(kept, x)))


def gap_boundaries(segs: DataFrame, least: float = 1.5) -> DataFrame:
    """(video_id, boundary): middles of the pauses, none within ``least`` of the last accepted one."""
    b = gaps(segs, least).groupBy("video_id").agg(F.collect_list("middle").alias("m"))
    return b.select("video_id", F.explode(spaced("m", least)).alias("boundary"))


def apart(points: DataFrame, key: str, at: str, gap: float | None) -> DataFrame:
    """(key, at): of each series' points, in order, those at least ``gap`` after the last one kept; a series' points meet in one row. All of them without a gap."""
    if gap is None:
        return points
    return points.groupBy(key).agg(F.collect_list(at).alias("_p")).select(key, F.explode(spaced("_p", gap)).alias(at))


def silence_boundaries(signal: DataFrame, key: str, at: str, level: str, below: float, least: int, gap: float | None = None) -> DataFrame:
    """(key, at): the middle sample of every silent run (the later of two), none within ``gap`` of the last one kept."""
    w = Window.partitionBy(key, "_run")
    s = _runs(signal, key, at, level, below).withColumn("_n", F.count("*").over(w)).withColumn("_j", F.row_number().over(w.orderBy(at)) - 1)
    return apart(s.where((F.col("_n") >= least) & (F.col("_j") == F.floor(F.col("_n") / 2))).select(key, at), key, at, gap)


def _runs(signal: DataFrame, key: str, at: str, level: str, below: float) -> DataFrame:
    """(key, at, _run): the samples under a level, with what tells their runs apart: the difference of two row numbers."""
    w = Window.partitionBy(key).orderBy(at)
    s = signal.select(key, at, (F.col(level) < below).alias("_quiet")).withColumn("_i", F.row_number().over(w))
    run = F.col("_i") - F.row_number().over(Window.partitionBy(key, "_quiet").orderBy(at))
    return s.withColumn("_run", run).where("_quiet").select(key, at, "_run")


def silence_runs(signal: DataFrame, key: str, at: str, level: str, below: float, least: int) -> DataFrame:
    """(key, first, last, n): runs of at least ``least`` consecutive samples under a level."""
    runs = _runs(signal, key, at, level, below).groupBy(key, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("_run")


def smoothed(signal: DataFrame, key: str, at: str, value: str, k: int) -> DataFrame:
    """``smooth``: mean of ``k`` samples with zeros beyond both ends, as a convolution of the same length gives; an even window sits half a step early. A series of fewer than ``k`` samples stays as it is."""
    ahead = (k - 1) // 2
    w = Window.partitionBy(key).orderBy(at).rowsBetween(ahead - k + 1, ahead)
    enough = F.count("*").over(Window.partitionBy(key)) >= k
    return signal.withColumn("smooth", F.when(enough, F.sum(value).over(w) / k).otherwise(F.col(value)))


def spikes(signal: DataFrame, key: str, at: str, value: str, k: int = 10, sigma: float = 2.5, gap: float | None = None) -> DataFrame:
    """(key, at, rise): samples after which the smoothed value rises by more than mean + sigma deviations of all rises of the series, none within ``gap`` of the last one kept."""
    w = Window.partitionBy(key).orderBy(at)
    d = smoothed(signal, key, at, value, k).withColumn("rise", F.lead("smooth").over(w) - F.col("smooth")).where("rise is not null")
    limit = d.groupBy(key).agg((F.avg("rise") + sigma * F.stddev_pop("rise")).alias("limit"))
    found = d.join(limit, key).where("rise > limit").select(key, at, "rise")
    return found if gap is None else apart(found, key, at, gap).join(found, [key, at])


def maxima(signal: DataFrame, key: str, at: str, value: str, k: int = 5, sigma: float = 1.8, gap: float | None = None) -> DataFrame:
    """(key, at, smooth): local maxima of the smoothed value above mean + sigma deviations of the series, none within ``gap`` of the last one kept."""
    w = Window.partitionBy(key).orderBy(at)
    s = smoothed(signal, key, at, value, k).withColumn("was", F.lag("smooth").over(w)).withColumn("next", F.lead("smooth").over(w))
    limit = s.groupBy(key).agg((F.avg("smooth") + sigma * F.stddev_pop("smooth")).alias("limit"))
    found = s.join(limit, key).where("smooth > was and smooth >= next and smooth > limit").select(key, at, "smooth")
    return found if gap is None else apart(found, key, at, gap).join(found, [key, at])


def nodes(boundaries: str | Column, duration: str | Column, least: int = 3, gap: float = 1.0, margin: float = 1.5) -> Column:
    """Array of struct(start, end): a video cut at the boundaries, at ``least`` pieces.

    Boundaries within ``margin`` of either end fall away, of two closer than ``gap`` the later one. With too few left,
    even cuts that keep both distances are added; if still too few, the cuts are the even ones alone.
    """
    d = F.col(duration) if isinstance(duration, str) else duration
    b = F.col(boundaries) if isinstance(boundaries, str) else boundaries
    kept = spaced(F.filter(b, lambda x: (x > margin) & (x < d - margin)), gap)
    even = F.transform(F.sequence(F.lit(1), F.lit(least - 1)), lambda i: F.round(i * d / least, 3))
    far = F.filter(even, lambda c: (c > margin) & (c < d - margin) & F.forall(kept, lambda x: F.abs(c - x) >= gap))
    # of the even cuts too, one must keep its distance from those added before it
    more = F.array_sort(F.concat(kept, spaced(far, gap)))
    cuts = F.when(F.size(kept) + 1 >= least, kept).when(F.size(more) + 1 >= least, more).otherwise(even)
    times = F.concat(F.array(F.lit(0.0)), F.transform(cuts, lambda x: F.round(x, 3)), F.array(F.round(d, 3)))
    return F.transform(F.sequence(F.lit(1), F.size(times) - 1), lambda i: F.struct(F.element_at(times, i).alias("start"), F.element_at(times, i + 1).alias("end")))


def align(scenes: list[tuple[float, float]], said: list[tuple[float, float, str, str]]) -> list[tuple[int, float, float, str, str]]:
    """(scene, start, end, text, speaker): each segment in the scene that holds its larger part, pauses filled in.

    A segment over a scene's end goes to that scene unless more of it lies behind; then the next scene takes it whatever
    its length. Pauses of 0.05 s before a segment and of 1 s at a scene's end become silent rows; a scene without
    segments is one silent row.
    """
    out, m, owed = [], 0, False
    for k, (a, b) in enumerate(scenes):
        at, rows = a, []
        while m < len(said):
            start, end, text, speaker = said[m]
            if not (end < b or owed or (start < b and b - start >= end - b)):
                owed = start < b
                break
            if start - at >= 0.05:
                rows.append((at, start, "", ""))
            rows.append((max(start, a), min(end, b), text, speaker))
            at, m, owed = end, m + 1, False
        if b - at >= 1.0:
            rows.append((at, b, "", ""))
        out += [(k, round(s, 2), round(e, 2), t, p) for s, e, t, p in rows or [(a, b, "", "")]]
    return out


def align_transcripts(scenes: DataFrame, segs: DataFrame) -> DataFrame:
    """``align`` for every video: scenes(video_id, start, end), segs(video_id, start, end, text, speaker). One video's rows meet in one task, in order."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(["start", "end"]), b.sort_values(["start", "end"])
        rows = align(list(zip(a["start"], a["end"])), list(zip(b["start"], b["end"], b["text"].fillna(""), b["speaker"].fillna(""))))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["video_id", "scene", "start", "end", "text", "speaker"])

    schema = "video_id string, scene int, start double, end double, text string, speaker string"
    return scenes.groupBy("video_id").cogroup(segs.groupBy("video_id")).applyInPandas(run, schema)
