"""Column functions over ids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIDEO_ID = r"([A-Za-z0-9_-]{11})(?:\.[A-Za-z0-9]+)?(?:[?&#].*)?[/\\\s]*$"


def canonical_video_id(c: str | Column) -> Column:
    """The 11-character id, whatever stands around it: a folder, an address, an extension, spaces."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract(c, VIDEO_ID, 1)
    return F.when(found != "", found).otherwise(F.trim(c))


def split_name(c: str | Column) -> Column:
    """train, val or test for any of their spellings; null for the rest."""
    s = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return (
        F.when(s.isin("train", "training"), "train")
        .when(s.isin("val", "validation"), "val")
        .when(s == "test", "test")
    )


def relation_label(c: str | Column) -> Column:
    """Trimmed, upper-cased, spaces and hyphens as underscores."""
    return F.translate(F.upper(F.trim(F.col(c) if isinstance(c, str) else c)), " -", "__")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shorten(c: str | Column, n: int) -> Column:
    """The first ``n`` characters and "..." if there are more."""
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, n), F.lit("..."))).otherwise(_c(c))


def scene_uid(video: str | Column, scene: str | Column) -> Column:
    return F.concat(_c(video), F.lit("_scene_"), _c(scene).cast("string"))


def scene_of_uid(uid: str | Column) -> Column:
    """The scene number at the end of a uid; null if there is none."""
    n = F.regexp_extract(_c(uid), r"_(\d+)$", 1)
    return F.when(n != "", n.cast("int"))


def first_number(c: str | Column) -> Column:
    n = F.regexp_extract(_c(c), r"\d+", 0)
    return F.when(n != "", n.cast("bigint"))


def timecode_seconds(c: str | Column) -> Column:
    """Seconds of H:M:S.f, M:S or S; null for anything else."""
    p = F.transform(F.split(F.trim(_c(c)), ":"), lambda x: x.try_cast("double"))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s * 60 + x)
    return F.when(F.size(p).between(1, 3), total)


def duration(frames: Column, fps: Column, default: float = 30.0) -> Column:
    """Seconds of a video; a missing or zero rate is the default, missing frames make 0."""
    rate = F.when((fps > 0) & ~F.isnan(fps.cast("double")), fps.cast("double")).otherwise(default)
    return F.coalesce(frames.cast("double") / rate, F.lit(0.0))


def span_start(c: str | Column) -> Column:
    return F.get(_c(c), F.lit(0))


def span_end(c: str | Column) -> Column:
    return F.when(F.size(_c(c)) > 0, F.element_at(_c(c), -1))


def clip_length(seconds: Column) -> Column:
    """8 % of a video, between 0.8 and 3 seconds."""
    return F.greatest(F.lit(0.8), F.least(F.lit(3.0), 0.08 * seconds))


def spoken_lines(speakers: str | Column, texts: str | Column, sep: str = "\n") -> Column:
    """``speaker: text`` for each non-blank text, as far as both lists go; empty if there is none."""
    pairs = F.filter(F.arrays_zip(_c(speakers).alias("s"), _c(texts).alias("t")), lambda x: (F.trim(x["t"]) != "") & x["s"].isNotNull())
    return F.coalesce(F.array_join(F.transform(pairs, lambda x: F.concat(x["s"], F.lit(": "), F.trim(x["t"]))), sep), F.lit(""))


def fit(c: str | Column, size: str | Column, filler: str = "") -> Column:
    """A list cut or filled up to ``size``."""
    n = _c(size).cast("int")
    return F.slice(F.concat(F.coalesce(_c(c), F.array().cast("array<string>")), F.array_repeat(F.lit(filler), n)), F.lit(1), n)


def same_caption(a: str | Column, b: str | Column, n: int = 40) -> Column:
    """Whether either text holds the first ``n`` characters of the other."""
    return F.contains(_c(a), F.substring(_c(b), 1, n)) | F.contains(_c(b), F.substring(_c(a), 1, n))


def embedding_text(transcript: Column, caption: Column, visual: dict[str, Column], tags: Column, vibes: Column) -> Column:
    """The text that stands for a scene when it is embedded; missing parts get their defaults."""
    # The visual fields with what is written where one is missing.
    default = {"mood": "neutral", "lighting": "unknown", "background": "unknown", "color_temperature": "unknown", "color_saturation": "medium", "color_lightness": "medium"}
    said = F.when(F.length(transcript) > 0, transcript).otherwise("(no spoken dialogue)")
    listed = lambda a: F.coalesce(F.when(F.size(a) > 0, F.array_join(a, ", ")), F.lit("none"))
    looks = [F.concat(F.lit(k.replace("_", " ").capitalize() + ": "), F.coalesce(visual.get(k, F.lit(None).cast("string")), F.lit(d))) for k, d in default.items()]
    return F.concat_ws("\n", F.lit("Transcript:"), said, F.lit("Caption:"), F.coalesce(caption, F.lit("(no caption)")), *looks, F.concat(F.lit("Tags: "), listed(tags)), F.concat(F.lit("Vibes: "), listed(vibes)))


def unfenced(raw: str | Column) -> Column:
    """A model's output without code fences around it."""
    t = F.regexp_replace(F.trim(_c(raw)), r"(?i)^```(?:json)?\s*", "")
    return F.trim(F.regexp_replace(t, r"\s*```$", ""))


def snap(label: Column, labels: tuple[int, ...]) -> Column:
    """The allowed label nearest to a number, the smaller of two."""
    near = F.array(*(F.struct(F.abs(label - x).alias("d"), F.lit(x).alias("x")) for x in labels))
    return F.when(label.isNotNull(), F.array_min(near)["x"])


def verdict(raw: str | Column, labels: tuple[int, ...] = (0, 1, 2)) -> Column:
    """struct(predicted_label, explanation) of a model's raw output.

    The widest {...} is read as JSON if it is sound and holds a whole number as ``predicted_label``; else the first
    ``label: n`` anywhere; else the label is -1. Labels snap to the allowed ones. Null or empty output is -1.
    """
    text = unfenced(raw)
    # fixed values: the patterns that find the object and the loose label
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    doc = F.try_parse_json(F.when(body != "", body).otherwise(text))
    said = F.trim(F.try_variant_get(doc, "$.predicted_label", "string"))
    number = F.when(said.rlike(r"^[+-]?\d{1,9}$"), said.cast("int"))
    loose = F.regexp_extract(text, r"(?i)(?:predicted[-_ ]label|label|prediction)\s*[\"']?\s*[:=]\s*[\"']?\s*(\d+)", 1)
    loose = F.when(loose.rlike(r"^\d{1,9}$"), loose.cast("int"))
    empty = _c(raw).isNull() | (_c(raw) == "")
    return F.struct(
        F.when(empty, -1).otherwise(F.coalesce(snap(number, labels), snap(loose, labels), F.lit(-1))).alias("predicted_label"),
        F.when(empty, "Empty LLM response").when(number.isNotNull(), F.try_variant_get(doc, "$.explanation", "string")).when(loose.isNotNull(), "Broad Regex").otherwise("Parsing failed").alias("explanation"),
    )


def dominant_label(distribution: str | Column) -> Column:
    """struct(label, count, total) of a JSON object {label: count}; the smaller label of equal counts; null if it can't be read."""
    m = F.from_json(_c(distribution), "map<string,int>")
    e = F.map_entries(m)
    best = F.array_max(F.transform(e, lambda x: F.struct(x["value"].alias("n"), (-x["key"].try_cast("int")).alias("k"))))
    return F.when(F.size(e) > 0, F.struct((-best["k"]).alias("label"), best["n"].alias("count"), F.aggregate(F.map_values(m), F.lit(0), lambda s, x: s + x).alias("total")))
