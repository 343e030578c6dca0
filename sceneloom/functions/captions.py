"""Texts that built-in functions cannot handle: normal forms, transliteration, and JSON inside a model's output."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Symbols that captions lose, punctuation set apart, and how a caption is rescued from broken JSON.
_DROP = re.compile("[“”‘’—–£€¥₹¤±©®™]")
_APART = re.compile(r"([,.;:!?()\"'/\\-])")
_LOOSE = re.compile(r'"scene_id"\s*:\s*(\d+).*?"caption"\s*:\s*("(?:[^"\\]|\\.)*")', re.DOTALL)
# Letters that have no base letter, with the ASCII letters that stand for them.
_LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ħ": "h", "ı": "i", "ŋ": "ng", "ŧ": "t", "ĸ": "k",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "ch", "ψ": "ps", "ω": "o",
}
BATCH = T.ArrayType(T.StructType([T.StructField("scene_id", T.IntegerType()), T.StructField("caption", T.StringType())]))
_JSON = json.JSONDecoder()


def plain_caption(text: str | None) -> str:
    """Lower case; letters as their base letters, or as the ASCII letters that stand for them; symbols dropped, punctuation set apart, single spaces.

    Letters of other scripts than Latin, Cyrillic and Greek stay as they are.
    """
    kept = _DROP.sub("", unicodedata.normalize("NFKC", text or "")).lower()
    bare = (c for c in unicodedata.normalize("NFD", kept) if not unicodedata.combining(c))
    return " ".join(_APART.sub(r" \1 ", "".join(_LETTERS.get(c, c) for c in bare)).split())


def json_values(text: str) -> Iterator[object]:
    """Every sound JSON object or list in a text, outermost first come first; inside a broken one its sound parts are found."""
    at = 0
    while m := re.compile(r"[\[{]").search(text, at):
        try:
            value, at = _JSON.raw_decode(text, m.start())
            yield value
        except ValueError:
            at = m.start() + 1


def _captions(value: object) -> Iterator[dict]:
    if isinstance(value, list):
        for x in value:
            yield from _captions(x)
    elif isinstance(value, dict):
        if str(value.get("scene_id")).isdigit() and value.get("caption") is not None:
            yield {"scene_id": int(value["scene_id"]), "caption": str(value["caption"])}
        else:
            for name in ("scenes", "captions"):
                yield from _captions(value.get(name))


def batch_captions(raw: str | None) -> list[dict]:
    """(scene_id, caption) pairs of a model's output: of all objects with both, in a list, under ``scenes`` or ``captions``, line by line, or whole ones in a broken list; else of the loose pattern."""
    found = [pair for value in json_values(raw or "") for pair in _captions(value)]
    return found or [{"scene_id": int(i), "caption": said} for i, quoted in _LOOSE.findall(raw or "") if (said := _unquoted(quoted)) is not None]


def _unquoted(quoted: str) -> str | None:
    try:
        return json.loads(quoted, strict=False)
    except ValueError:
        return None


def first_object(raw: str | None) -> str | None:
    """The JSON object that starts at the first brace of a model's output, or the list that is all of it, fenced or not; null if it is not sound."""
    text = re.sub(r"```(?:json)?", "", raw or "").strip()
    at = 0 if text.startswith("[") else text.find("{")
    try:
        return None if at < 0 else json.dumps(_JSON.raw_decode(text, at)[0], ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def normal_caption(s: pd.Series) -> pd.Series:
    return s.map(plain_caption)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x).strip() if isinstance(x, str) else None)


@F.pandas_udf(T.StringType())
def json_object(s: pd.Series) -> pd.Series:
    return s.map(first_object)


@F.pandas_udf(BATCH)
def parsed_captions(s: pd.Series) -> pd.Series:
    return s.map(batch_captions)
