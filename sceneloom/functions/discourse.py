"""Fixed vocabularies of discourse relations, and columns over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneloom.functions.text import relation_label

# The relation types in code order, with the phrase that glosses each.
GLOSS = {
    "ELABORATION": "elaborates on",
    "ATTRIBUTION": "attributed to",
    "JOINT": "alongside",
    "SAME_UNIT": "continues from",
    "CONTRAST": "contrasts with",
    "EXPLANATION": "explains",
    "BACKGROUND": "sets the background for",
    "CAUSE": "causes",
    "ENABLEMENT": "enables",
    "EVALUATION": "evaluates",
    "TEMPORAL": "followed in time by",
    "CONDITION": "conditions",
    "COMPARISON": "compares with",
    "TOPIC_CHANGE": "shifts topic from",
    "SUMMARY": "summarizes",
    "MANNER_MEANS": "means of",
    "TEXTUAL_ORGANIZATION": "organizes",
    "TOPIC_COMMENT": "comments on",
    "ROOT": "opens with",
    "SPAN": "continues with",
}
# The types of the topology vector, and those that count as dynamic.
CANONICAL = ("TEMPORAL", "JOINT", "ROOT", "ELABORATION", "SPAN", "CONTRAST", "TOPIC_COMMENT", "CAUSE", "BACKGROUND", "COMPARISON", "MANNER_MEANS")
DYNAMIC = ("TEMPORAL", "CONTRAST", "CAUSE")


def known_relation(c: str | Column) -> Column:
    """The normalised label; JOINT for unknown and null ones."""
    label = relation_label(c)
    return F.when(label.isin(*GLOSS), label).otherwise("JOINT")


def gloss(c: str | Column) -> Column:
    """The phrase for a type; an unknown type in lower case with spaces."""
    c = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*(F.lit(x) for kv in GLOSS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(c)), F.translate(F.lower(c), "_", " "))


def chain_gloss(c: str | Column, sep: str = " -> ") -> Column:
    """The phrases of a chain of types, joined."""
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, gloss), sep)


def relation_code(c: str | Column, most: int | None = None) -> Column:
    """The number of a relation in the vocabulary's order, JOINT's for unknown ones; codes above ``most`` are lowered to it, as for a model with fewer types."""
    codes = F.create_map(*(F.lit(x) for i, k in enumerate(GLOSS) for x in (k, i)))
    code = F.element_at(codes, known_relation(c))
    return code if most is None else F.least(code, F.lit(most))
