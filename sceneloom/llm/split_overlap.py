"""Same or near-same records across splits: minwise hashing with banded buckets, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.words import hashed, words
from sceneloom.runtime import cut, spread

BANDS, ROWS = 24, 9


def edits_within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance (insert, delete, replace) of two lists is at most ``most``; only that band of the table is filled."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                new[0] = i
                continue
            new[j] = min(row.get(j - 1, far) + (x != b[j - 1]), row.get(j, far) + 1, new.get(j - 1, far) + 1)
        if min(new.values()) > most:
            return False
        row = new
    return row.get(len(b), far) <= most


def signatures(tokens: np.ndarray, sizes: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> np.ndarray:
    """Band keys of each word list (all non-empty): minwise hashes over its words, a repeated word counting as further ones."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((tokens, doc))
    t, d = tokens[order], doc[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    with np.errstate(over="ignore"):
        x = t + (np.arange(len(t)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x = ((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype(np.uint32)
        rng = np.random.default_rng(seed)
        mul = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        keys = np.zeros((len(sizes), bands), np.uint64)
        turned = np.empty_like(x)
        for k, m in enumerate(mul):
            np.multiply(x, m, out=turned)
            low = np.minimum.reduceat(turned, starts)
            band = k // rows
            keys[:, band] = (keys[:, band] ^ low.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    return keys


def text_links(df: DataFrame, key: str, text: str, side: str, shortest: int = 8, per_edit: int = 15) -> tuple[DataFrame, DataFrame]:
    """(members(key, train, cls), links(t, e)): records by class, and the pairs of a train and an evaluation class whose texts have a word edit distance of at most n // ``per_edit``.

    ``side`` is true for train, false for evaluation, null for neither; n is the longer text's number of words, and
    both need at least ``shortest``. Equal word lists form one class, and the search runs over classes: minwise hashes
    of a class's words (repeats numbered, so this is the Jaccard similarity of multisets) are banded into buckets, and
    only a train class and an evaluation class that share a bucket and whose lengths allow the distance are candidates.
    Such a pair has a Jaccard similarity of at least (n - n // p) / (n + n // p), 0.875 for p = 15; with BANDS bands of
    ROWS hashes a pair at this limit is missed once in 5000. Candidates are verified by exact Jaccard similarity
    against that limit, then by exact distance. A class that has records on both sides is linked to itself.

    Members are never expanded into pairs here, so copies cost nothing. Buckets and classes are never gathered: the
    joins stream, and adaptive execution splits hot keys.

    Edge cases: null keys and texts, and texts of fewer words, have no partner; rows with one key, side and text are
    one record; an empty table gives an empty result; other columns are ignored.
    """
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(side).alias("train")).where("key is not null and text is not null and train is not null"))

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            lists = [words(t) for t in pdf["text"]]
            keep = np.fromiter((len(w) >= shortest for w in lists), bool, len(lists))
            lists = [w for w in lists if len(w) >= shortest]
            flat, sizes = hashed(lists)
            cls = [xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in lists]
            tokens = np.split(flat.view(np.int64), np.cumsum(sizes)[:-1]) if lists else []
            lists = {"cls": pd.Series(cls, dtype=object), "tokens": pd.Series(list(tokens), dtype=object)}  # typed also where they are empty
            yield pd.DataFrame({"key": pdf["key"][keep].to_numpy(), "train": pdf["train"][keep].to_numpy()} | lists)

    kind = df.schema[key].dataType.simpleString()
    folded = cut(rows.mapInPandas(fold, f"key {kind}, train boolean, cls binary, tokens array<bigint>"))
    members = folded.select("key", "train", "cls").distinct()
    classes = cut(folded.groupBy("cls").agg(F.first("tokens").alias("tokens"), F.max("train").alias("train"), F.min("train").alias("all_train")))

    def bands(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            sizes = pdf["tokens"].map(len).to_numpy(np.int64)
            keys = signatures(np.concatenate(pdf["tokens"].to_list()).view(np.uint64), sizes).view(np.int64)
            n = len(pdf)
            yield pd.DataFrame({
                "cls": np.repeat(pdf["cls"].to_numpy(), BANDS), "n": np.repeat(sizes, BANDS).astype(np.int32),
                "train": np.repeat(pdf["train"].to_numpy(), BANDS), "all_train": np.repeat(pdf["all_train"].to_numpy(), BANDS),
                "band": np.tile(np.arange(BANDS, dtype=np.int32), n), "bucket": keys.ravel(),
            })

    banded = cut(classes.mapInPandas(bands, "cls binary, n int, train boolean, all_train boolean, band int, bucket bigint"))
    left = banded.where("train").select(F.col("cls").alias("t"), F.col("n").alias("tn"), "band", "bucket")
    right = banded.where("not all_train").select(F.col("cls").alias("e"), F.col("n").alias("en"), "band", "bucket")
    pairs = left.join(right, ["band", "bucket"]).where(f"t <> e and abs(tn - en) <= greatest(tn, en) div {per_edit}").select("t", "e").distinct()
    full = pairs.join(classes.select(F.col("cls").alias("t"), F.col("tokens").alias("a")), "t").join(classes.select(F.col("cls").alias("e"), F.col("tokens").alias("b")), "e")

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ok = []
            for a, b in zip(pdf["a"], pdf["b"]):
                n = max(len(a), len(b))
                most = n // per_edit
                both = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
                ok.append(both * (n + most) >= (n - most) * (len(a) + len(b) - both) and edits_within(a.tolist(), b.tolist(), most))
            yield pdf.loc[ok, ["t", "e"]]

    links = full.mapInPandas(verify, "t binary, e binary")
    same = classes.where("train and not all_train").select(F.col("cls").alias("t"), F.col("cls").alias("e"))
    return members, links.unionByName(same)


def name_links(df: DataFrame, key: str, name: str, side: str) -> tuple[DataFrame, DataFrame]:
    """As ``text_links`` for records that share a ``name`` exactly: the name is the class; nulls have no partner, repeated rows count once.

    A name is a set of one shingle, whose minwise hash in every band is that of the name, so one join on it is exact.
    """
    members = df.select(F.col(key).alias("key"), F.col(side).alias("train"), F.col(name).alias("cls")).where("key is not null and cls is not null and train is not null").distinct()
    both = members.groupBy("cls").agg(F.max("train").alias("some"), F.min("train").alias("every")).where("some and not every")
    return members, both.select(F.col("cls").alias("t"), F.col("cls").alias("e"))


def linked_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(train_key, eval_key): every pair of records of linked classes, once."""
    train = members.where("train").select(F.col("cls").alias("t"), F.col("key").alias("train_key"))
    other = members.where("not train").select(F.col("cls").alias("e"), F.col("key").alias("eval_key"))
    return links.join(train, "t").join(other, "e").select("train_key", "eval_key").distinct()


def linked_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, train, class, links): a row for each record of a linked class, which its smallest key names, with its number of partners on the other side; no pair of records is made."""
    sizes = members.groupBy("cls").agg(F.count_if("train").alias("trains"), F.count_if(~F.col("train")).alias("evals"), F.min("key").alias("class"))
    of = lambda c, n: sizes.select(F.col("cls").alias(c), F.col(n).alias("n"))
    partners = links.join(of("e", "evals"), "e").select(F.col("t").alias("cls"), F.lit(True).alias("train"), "n").unionByName(links.join(of("t", "trains"), "t").select(F.col("e").alias("cls"), F.lit(False).alias("train"), "n"))
    linked = partners.groupBy("cls", "train").agg(F.sum("n").alias("links")).join(sizes.select("cls", "class"), "cls")
    return members.join(linked, ["cls", "train"]).select("key", "train", "class", "links")


def overlap_counts(members: DataFrame, links: DataFrame, of: DataFrame) -> DataFrame:
    """(split, eval_source, train_source, pairs, eval_records): sums over linked classes, whose members are only counted, by the ``split`` and ``source`` of each record in ``of``(key, split, source)."""
    n = members.join(of, "key").groupBy("cls", "train", "split", "source").agg(F.count("*").alias("n"))
    train = n.where("train").groupBy(F.col("cls").alias("t"), F.col("source").alias("train_source")).agg(F.sum("n").alias("nt"))
    other = n.where("not train").select(F.col("cls").alias("e"), "split", F.col("source").alias("eval_source"), F.col("n").alias("ne"))
    met = links.join(train, "t").join(other, "e").groupBy("e", "split", "eval_source", "train_source").agg(F.sum(F.col("nt") * F.col("ne")).alias("pairs"), F.max("ne").alias("ne"))
    return met.groupBy("split", "eval_source", "train_source").agg(F.sum("pairs").alias("pairs"), F.sum("ne").alias("eval_records"))


def overlapping_texts(df: DataFrame, key: str, text: str, side: str, shortest: int = 8, per_edit: int = 15) -> DataFrame:
    """(train_key, eval_key) of ``text_links``."""
    return linked_pairs(*text_links(df, key, text, side, shortest, per_edit))


def overlapping_keys(df: DataFrame, key: str, name: str, side: str) -> DataFrame:
    """(train_key, eval_key) of ``name_links``."""
    return linked_pairs(*name_links(df, key, name, side))
