"""All query modules of the subpackage."""

from sceneloom.llm import (
    plan_answer_defects,
    plan_containers,
    plan_encoding,
    plan_eval_leakage,
    plan_frequent_sequences,
    plan_similar_vectors,
    plan_split_overlap,
    plan_top_items,
)

MODULES = [plan_answer_defects, plan_similar_vectors, plan_top_items, plan_split_overlap, plan_frequent_sequences, plan_containers, plan_eval_leakage, plan_encoding]
