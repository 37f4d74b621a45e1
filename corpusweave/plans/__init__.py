"""Registered plans, grouped by workload."""

from importlib import import_module

FAMILIES = (
    "text_plans",
    "corpus_plans",
    "segment_plans",
    "vector_plans",
    "lexical_plans",
    "answer_plans",
    "question_plans",
    "identity_plans",
    "concept_plans",
    "metric_plans",
    "stream_plans",
    "source_plans",
)


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"corpusweave.plans.{family}")
