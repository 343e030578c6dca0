"""Words of a text: runs of letters, digits and underscores after NFKC folding and lower-casing; markup tags are none."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash

_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def hashed(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in one array, number of words of each list); each different word is hashed once."""
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    flat = [w for x in lists for w in x]
    codes, unique = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in unique), np.uint64, len(unique))
    return (table[codes] if flat else np.zeros(0, np.uint64)), sizes
