"""The discourse channel of evidence, and what is written for a model to read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.vectors import blend, cosine
from sceneloom.operators.evidence import best_per_video, top_k
from sceneloom.operators.nearest import nearest

# What stands in place of a block that is left out because the prompt is too long, in the order in which they go.
OVERFLOW = (("graph", "Knowledge graph context truncated — prompt exceeded context window."), ("narrative", "Discourse pattern context truncated — prompt exceeded context window."), ("content", "Content similarity context truncated — prompt exceeded context window."))


def discourse_evidence(
    queries: DataFrame, library: DataFrame, topologies: DataFrame, key: str, vec: str, dim: int, video: str = "video_id", each: int = 30, k: int = 5, alpha: float = 0.7
) -> DataFrame:
    """(query, video_id, hit, dense, topology, score, rank): the ``k`` library videos closest to each query video in content and discourse.

    Each of ``queries``(key, video, vec), the scenes of the query videos or one vector of each, looks up its ``each``
    nearest library scenes. A hit scores ``alpha`` times its cosine and the rest times the cosine of both videos'
    vectors of ``topologies``(video, topology); a query without one counts as all zero, a library video without one is
    no candidate. Each video keeps its best hit (ties by the hit's key), then the best videos do (ties by video).

    Only queries x each rows leave the search; the topologies join on the video.
    """
    near = nearest(queries, library, each, key, vec, dim)
    zero = F.array_repeat(F.lit(0.0), F.size("t"))
    hits = (
        near.join(queries.select(F.col(key).alias("query"), F.col(video).alias("asker")), "query")
        .join(library.select(F.col(key).alias("hit"), F.col(video).alias("video_id")), "hit")
        .where("asker <> video_id")
        .join(topologies.select(F.col(video).alias("video_id"), F.col("topology").alias("t")), "video_id")
        .join(topologies.select(F.col(video).alias("asker"), F.col("topology").alias("own")), "asker", "left")
        .select(F.col("asker").alias("query"), "video_id", "hit", F.col("cosine").alias("dense"), cosine(F.coalesce("own", zero), "t").alias("topology"))
    )
    scored = hits.withColumn("score", F.round(blend("dense", "topology", alpha), 9))
    return top_k(best_per_video(scored, score="score", order="hit"), k, score="score")


def titled(title: str, body: str | Column, none: str | None = None) -> Column:
    """A title over a block; the text ``none`` under it where the block is missing or blank, or null where that is null too."""
    c = F.col(body) if isinstance(body, str) else body
    there = F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(there, F.concat(F.lit(title + "\n"), c)).otherwise(F.lit(None if none is None else f"{title}\n{none}"))


def user_prompt(mode: str | Column, context: Column, content: Column, narrative: Column, graph: Column, task: str) -> Column:
    """The blocks that the evidence mode lets see, then the task: content and narrative in ``milvus``, graph in ``graph``, all in ``full``."""
    m = F.col(mode) if isinstance(mode, str) else mode
    library, structure = m.isin("milvus", "full"), m.isin("graph", "full")
    return F.concat_ws("\n\n", context, F.when(library, content), F.when(library, narrative), F.when(structure, graph), F.lit(task))


def system_prompt(mode: str | Column, opening: str, sources: dict[str, str], alone: str, labels: dict[int, str]) -> Column:
    """The opening, the labels' meaning and how to use the sources of ``sources``(milvus, graph) that the mode has; ``alone`` where it has none."""
    m = F.col(mode) if isinstance(mode, str) else mode
    use = F.concat_ws("\n\n", *(F.when(m.isin(name, "full"), F.lit(text)) for name, text in sources.items()))
    meaning = "\n".join(f"{k} = {v}" for k, v in labels.items())
    return F.concat_ws("\n\n", F.lit(opening), F.lit(meaning), F.when(use == "", F.lit(alone)).otherwise(use))


def fitted_blocks(tokens: str | Column, most: int, **blocks: str) -> dict[str, Column]:
    """The blocks of a prompt of ``tokens`` tokens: where these are more than ``most``, the first block of OVERFLOW that is there becomes its notice; the others stay.

    ``blocks`` names the columns of graph, narrative and content, of which any may be null or left out.
    """
    over = (F.col(tokens) if isinstance(tokens, str) else tokens) > most
    out, open_ = {}, F.lit(True)
    for name, notice in OVERFLOW:
        if name in blocks:
            c = F.col(blocks[name])
            here = over & open_ & c.isNotNull()
            out[name] = F.when(here, F.lit(notice)).otherwise(c)
            open_ = open_ & c.isNull()
    return out


def numbered_lines(df: DataFrame, key: str, order: str, line: Column, name: str = "block", sep: str = "\n") -> DataFrame:
    """(key, name): the rows' lines in order as one text. The text is the feature, so a key's lines meet in one row; the caller bounds them."""
    rows = F.array_sort(F.collect_list(F.struct(order, line.alias("_l"))))
    return df.groupBy(key).agg(rows.alias("_r")).select(key, F.array_join(F.transform("_r", lambda x: x["_l"]), sep).alias(name))


def pooled(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(key, pooled): means and then maxima of each dimension over a graph's nodes; null vectors and those of other length don't count."""
    rows = df.where(F.size(vec) == dim).select(key, *(F.get(F.col(vec), F.lit(i)).cast("double").alias(f"_{i}") for i in range(dim)))
    each = reduce(lambda a, f: a + [f(f"_{i}") for i in range(dim)], (F.avg, F.max), [])
    return rows.groupBy(key).agg(F.array(*each).alias("pooled"))


def nearest_code(df: DataFrame, codebook: DataFrame, key: str, vec: str, code: str, most: int = 4096) -> DataFrame:
    """(key, code, distance): the code whose vector has the least squared distance to each row's, ties to the smaller code.

    The codebook is a parameter of a model; one of more than ``most`` codes is an error, so the broadcast row is bounded.
    """
    n = codebook.count()
    if n > most:
        raise ValueError(f"a codebook of {n} codes is larger than {most}")
    rows = codebook.agg(F.collect_list(F.struct(F.col(code).alias("code"), F.transform(vec, lambda x: x.cast("double")).alias("e"))).alias("_cs"))
    d = lambda c: F.aggregate(F.zip_with(F.col(vec), c["e"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_cs", lambda c: F.struct(F.round(d(c), 9).alias("d"), c["code"].alias("code"))))
    return df.where(F.col(vec).isNotNull()).withColumn("_one", F.lit(1)).join(F.broadcast(rows.withColumn("_one", F.lit(1))), "_one").select(key, best.alias("b")).select(key, F.col("b.code").alias(code), F.col("b.d").alias("distance"))
