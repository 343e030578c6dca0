"""Discourse trees as bracketed text: parsing, spans with roles and relations, and links between units."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[()]|[^\s()]+")
# The roles that a node's pattern gives its children.
ROLES = {"nucleus-nucleus": "NN", "nucleus-satellite": "NS", "satellite-nucleus": "SN"}


def parse_tree(text: str) -> tuple:
    """(label, children) for a node, an int from 1 for a leaf ``(text n)`` with n from 0. ValueError for anything malformed."""
    tokens = _TOKEN.findall(text)
    stack: list[tuple[str, list]] = []
    done = None
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if done is not None:
            raise ValueError("text after the tree")
        if t == "(":
            label = tokens[i + 1] if i + 1 < len(tokens) else ")"
            if label in "()":
                raise ValueError("node without a label")
            if label.lower() == "text":
                if i + 3 >= len(tokens) or not tokens[i + 2].isdigit() or tokens[i + 3] != ")":
                    raise ValueError("a leaf is (text <number>)")
                node: object = int(tokens[i + 2]) + 1
                i += 4
            else:
                stack.append((label, []))
                i += 2
                continue
        elif t == ")" and stack:
            label, kids = stack.pop()
            if not kids:
                raise ValueError(f"node {label} without children")
            node = (label, kids)
            i += 1
        else:
            raise ValueError(f"unexpected {t}")
        if stack:
            stack[-1][1].append(node)
        else:
            done = node
    if done is None:
        raise ValueError("tree is not closed")
    return done


def _pattern(label: str) -> tuple[str, str]:
    pattern, sep, rel = label.partition(":")
    return pattern.lower(), rel.lower() if sep else "span"


def _children(node: tuple) -> list[tuple[object, str, str]]:
    """(child, role, relation) of a node: the relation goes to the satellite, or to both of two nuclei; the rest are spans."""
    pattern, rel = _pattern(node[0])
    kids = node[1]
    roles = "N" if len(kids) == 1 else ROLES.get(pattern, ("S" if pattern == "satellite" else "N") * len(kids))
    roles += "N" * (len(kids) - len(roles))
    named = {"nucleus-nucleus": "NS", "nucleus-satellite": "S", "satellite-nucleus": "S"}.get(pattern, "S")
    return [(k, r, rel if r in named else "span") for k, r in zip(kids, roles)]


def _ends(node: object) -> tuple[int, int]:
    a = b = node
    while isinstance(a, tuple):
        a = a[1][0]
    while isinstance(b, tuple):
        b = b[1][-1]
    return a, b


def spans(node: object, role: str = "N", rel: str = "ROOT") -> list[tuple[int, int, str, str]]:
    """(first unit, last unit, role, relation) of every node, children before parents."""
    out: list[tuple[int, int, str, str]] = []
    todo = [(node, role, rel, False)]
    while todo:
        n, r, x, seen = todo.pop()
        if seen or not isinstance(n, tuple):
            out.append((*_ends(n), r, x))
        else:
            todo.append((n, r, x, True))
            todo += [(k, kr, kx, False) for k, kr, kx in reversed(_children(n))]
    return out


def links(node: object) -> list[tuple[int, int, str]]:
    """(head of the left part, head of the right part, the parent's own relation) of every binary node, children first.

    A head is the nucleus's, the left one's of two. A node of one child is that child; more than two are an error.
    """
    out: list[tuple[int, int, str]] = []

    def head(n: object, rel: str) -> int:
        while isinstance(n, tuple) and len(n[1]) == 1:
            n = n[1][0]
        if not isinstance(n, tuple):
            return n
        kids = _children(n)
        if len(kids) != 2:
            raise ValueError("a node has more than two children")
        (a, ra, xa), (b, rb, xb) = kids
        ha, hb = head(a, xa), head(b, xb)
        out.append((ha, hb, rel))
        return hb if ra != "N" and rb == "N" else ha

    head(node, "ROOT")
    return out


SPANS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("s", T.IntegerType()), ("e", T.IntegerType()), ("nuc", T.StringType()), ("rel", T.StringType()))]))
LINKS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("src", T.IntegerType()), ("tgt", T.IntegerType()), ("rel", T.StringType()))]))


def _try(f, text):
    try:
        return f(parse_tree(text)) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(SPANS)
def tree_spans(s: pd.Series) -> pd.Series:
    """Spans of a tree's text; null if it is malformed."""
    return s.map(lambda t: _try(spans, t))


@F.pandas_udf(LINKS)
def tree_links(s: pd.Series) -> pd.Series:
    """Links of a tree's text; null if it is malformed or not binary."""
    return s.map(lambda t: _try(links, t))


# The marks that tokens are compared without.
_PLAIN = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "`": "'"})


def plain_token(t: str) -> str:
    """A token in lower case with straight quotes and plain dashes."""
    return t.strip().lower().translate(_PLAIN)


def align_units(tokens: list[str], units: list[str]) -> list[int]:
    """The number (from 1) of the unit that each token belongs to, by matching texts without spaces in order. ValueError where they differ."""
    out: list[int] = []
    bare = lambda t: "".join(plain_token(t).split())  # noqa: E731  a token too may hold spaces of other kinds
    for k, unit in enumerate(units, 1):
        want, got = bare(unit), ""
        while want and got != want:
            if len(out) == len(tokens) or not want.startswith(got + bare(tokens[len(out)])):
                raise ValueError(f"unit {k} does not match at token {len(out)}")
            got += bare(tokens[len(out)])
            out.append(k)
    while units and len(out) < len(tokens) and not bare(tokens[len(out)]):  # blank tokens at the end
        out.append(len(units))
    if len(out) != len(tokens):
        raise ValueError("tokens are left over")
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def aligned_units(tokens: pd.Series, units: pd.Series) -> pd.Series:
    """``align_units`` of arrays of tokens and units, one document a row; null where they differ or either is null."""

    def one(a, b) -> list[int] | None:
        try:
            return None if a is None or b is None else align_units(list(a), list(b))
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(tokens, units)], dtype=object)
