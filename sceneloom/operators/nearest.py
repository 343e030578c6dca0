"""Exact nearest neighbours of a stated query set, in blocks against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20  # of query vectors sent to the executors at once
TILE_QUERIES, TILE_ROWS = 512, 4096  # of one matrix product, 16 MB


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _best(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The ``k`` best rows of each query over all parts, ties by key."""
    return pd.concat(parts).sort_values(["i", "cosine", "hit"], ascending=[True, False, True]).groupby("i", sort=False).head(k)


def nearest(queries: DataFrame, index: DataFrame, k: int, key: str, vec: str, dim: int, match: str | None = None, skip: str | None = None) -> DataFrame:
    """(query, hit, cosine, row): the ``k`` rows of ``index`` with the highest cosine for each query, ties by key.

    ``match`` names a column that must be equal on both sides, ``skip`` one that must differ. Each block of at most
    BLOCK_BYTES of queries (131,072 of 64 dimensions) is sent to the executors and scored against every partition in
    tiles of matrix products; a partition keeps its best ``k`` per query, so what is shuffled is queries x k per
    partition, not pairs. Index rows are never moved, and read once a block. Cosines are rounded to 9 digits before
    they are ranked.

    Edge cases: null keys, null vectors and vectors of another length take no part; a zero vector has cosine 0 with all;
    empty sides give an empty result.
    """
    extra = [c for c in (match, skip) if c]
    sound = f"{key} is not null and size({vec}) = {dim} and forall({vec}, x -> x is not null and not isnan(x))"
    q, x = (df.select(key, vec, *extra).where(sound) for df in (queries, index))
    kind = index.schema[key].dataType.simpleString()
    kinds = f"query {kind}, hit {kind}, cosine double"
    blocks, parts = max(1, -(-q.count() * dim * 8 // BLOCK_BYTES)), []
    for b in range(blocks):
        held = q.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toArrow()
        if not held.num_rows:
            continue
        names = {c: {v: i for i, v in enumerate(dict.fromkeys(held.column(c).to_pylist()))} for c in extra}
        codes = {c: np.array([names[c][v] for v in held.column(c).to_pylist()]) for c in extra}
        of = held.schema.field(key).type
        shared = index.sparkSession.sparkContext.broadcast((held.column(key).to_pylist(), _unit(held.column(vec)), names, codes))

        def score(batches: Iterator[pa.RecordBatch], shared=shared, of=of) -> Iterator[pa.RecordBatch]:
            keys, m, names, own = shared.value
            best = pd.DataFrame({"i": [], "hit": [], "cosine": []})
            for batch in filter(lambda x: x.num_rows, batches):
                x, hits = _unit(batch.column(vec)), np.array(batch.column(key).to_pylist(), object)
                there = {c: np.array([names[c].get(v, -1) for v in batch.column(c).to_pylist()]) for c in extra}
                found = [best] if len(best) else []
                for a in range(0, len(m), TILE_QUERIES):
                    rows = slice(a, a + TILE_QUERIES)
                    tile = []
                    for b in range(0, len(x), TILE_ROWS):
                        cols = slice(b, b + TILE_ROWS)
                        s = np.round(m[rows] @ x[cols].T, 9)
                        if match:
                            s[own[match][rows, None] != there[match][None, cols]] = -np.inf
                        if skip:
                            s[own[skip][rows, None] == there[skip][None, cols]] = -np.inf
                        least = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else -np.inf
                        i, j = np.nonzero((s >= least) & (s > -np.inf))
                        tile.append(pd.DataFrame({"i": i + a, "hit": hits[j + b], "cosine": s[i, j]}))
                    found.append(_best(tile, k))
                best = _best(found, k)
            yield pa.RecordBatch.from_arrays([pa.array([keys[int(i)] for i in best["i"]], of), pa.array(best["hit"].tolist(), of), pa.array(best["cosine"], pa.float64())], names=["query", "hit", "cosine"])

        parts.append(x.mapInArrow(score, kinds))
    if not parts:
        return index.sparkSession.createDataFrame([], f"{kinds}, row int")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "hit")
    return reduce(DataFrame.unionByName, parts).withColumn("row", F.row_number().over(w)).where(F.col("row") <= k)
