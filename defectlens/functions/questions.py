"""Routing of questions, preset questions, fallback lists and error classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from defectlens.functions.paths import col

# A question goes to the first route one of whose words it contains.
ROUTES = {
    "why": ["why", "flagged"],
    "high": ["high-risk", "high risk"],
    "medium": ["medium"],
    "metrics": ["metrics", "features"],
    "top": ["top", "most bug", "most complex"],
}
PRESETS = {
    "top": "Which functions are most bug-prone?",
    "high": "Show high-risk functions",
    "medium": "Show medium-risk functions",
    "metrics": "What metrics does the model use?",
    "why": "Why was something flagged?",
}
ERROR_CLASSES = {
    "rate_limit": ["rate limit", "429"],
    "bad_model": ["not a valid model id", "deprecated", "404", "400"],
    "auth": ["api key", "401", "403"],
}


def _first_match(text: Column, classes: dict[str, list[str]], otherwise: str) -> Column:
    tests = [(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), name) for name, words in classes.items()]
    return reduce(lambda chain, test: chain.when(*test), tests[1:], F.when(*tests[0])).otherwise(otherwise)


def route_question(message: Column | str, has_rows: Column) -> Column:
    text = F.trim(F.lower(col(message)))
    return F.when(~has_rows, "upload").otherwise(_first_match(text, ROUTES, "free"))


def preset_question(key: Column | str) -> Column:
    """Question text of a preset key; null for other keys."""
    pairs = [F.lit(word) for pair in PRESETS.items() for word in pair]
    return F.try_element_at(F.create_map(*pairs), col(key))


def fallback_list(names: Column | str) -> Column:
    """Names in order, without blanks and repeats."""
    return F.array_distinct(F.filter(col(names), lambda n: n.isNotNull() & (n != "")))


def classify_error(message: Column | str) -> Column:
    return _first_match(F.lower(col(message)), ERROR_CLASSES, "other")
