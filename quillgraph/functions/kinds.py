"""What kind of thing a phrase names, kinds and relations by their common names, and spellings of ranges. Expressions that stay in the JVM; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import plain_number

#: Words that make a phrase a method, dataset or task.
METHOD_SIGNS = ["model", "method", "approach", "framework", "system", "architecture", "algorithm"]
DATASET_SIGNS = ["dataset", "corpus", "bench", "benchmark", "set"]
TASK_SIGNS = ["classification", "translation", "detection", "segmentation", "recognition", "prediction", "forecasting", "retrieval", "generation", "regression"]
SUBJECTS = ["we", "our", "this", "that", "it", "they", "he", "she", "i"]
#: Kinds of nodes, and other names for them.
NODE_KINDS = ["method", "model", "dataset", "metric", "task", "concept", "material", "organism", "finding", "process"]
KIND_NAMES = {
    "result": "finding", "outcome": "finding", "observation": "finding", "procedure": "process", "analysis": "process", "approach": "method", "algorithm": "method", "technique": "method",
}
#: Relations, and other names for them.
RELATION_NAMES = {
    "evaluated_on": "evaluates_on", "evaluates_on": "evaluates_on", "measures": "reports", "reports": "reports", "proposes": "proposes", "uses": "uses", "compares": "compares",
    "compared_to": "compares", "outperforms": "outperforms", "causes": "causes", "part_of": "part_of", "is_a": "is_a", "assumes": "assumes",
}
SHORT_PHRASE = 3


def _holds(low: Column, signs: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in signs]), lambda x: F.contains(low, x))


def phrase_kinds(t: Column) -> Column:
    """struct<method, dataset, task, value> of flags: whether a phrase may name such a thing. Phrases of several words may name any; one word needs a sign of it."""
    t = F.coalesce(t, F.lit(""))
    low, several = F.lower(t), F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))) >= 2
    long, capital, figure = F.length(t) >= SHORT_PHRASE, t.rlike(r"\p{Lu}"), t.rlike("[0-9]")
    return F.struct(
        (long & ~low.isin(SUBJECTS) & (_holds(low, METHOD_SIGNS) | capital | several)).alias("method"), (long & (_holds(low, DATASET_SIGNS) | figure | capital | several)).alias("dataset"),
        (long & (_holds(low, TASK_SIGNS) | low.rlike("(?:task|problem)$") | several)).alias("task"), figure.alias("value"),
    )


def settled_kind(kind: Column, name: Column, occurrences: Column, lead_words: list[str]) -> Column:
    """A method seen once whose name is over 8 words or 80 characters or begins with a filler becomes a keyword."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    words = F.regexp_extract_all(low, F.lit(r"\S+"), F.lit(0))
    noisy = (F.size(words) > 8) | (F.length(low) > 80) | F.coalesce(F.get(words, F.lit(0)).isin(lead_words), F.lit(False))
    return F.when((kind == "method") & (occurrences <= 1) & noisy, F.lit("keyword")).otherwise(kind)


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def node_kind(raw: Column) -> Column:
    """A kind of node; concept where the name is no kind."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.coalesce(_lookup(KIND_NAMES, low), F.when(low.isin(NODE_KINDS), low), F.lit("concept"))


def relation_name(raw: Column) -> Column:
    """A relation; null where the name is none."""
    return _lookup(RELATION_NAMES, F.lower(F.trim(F.coalesce(raw, F.lit("")))))


def dataset_of(t: Column) -> Column:
    """What stands behind the first "on", up to a word for a part of a dataset; null below two characters."""
    name = F.trim(F.split(F.regexp_extract(t, r"(?i)on\s+([A-Z0-9_/. -]{2,80})", 1), r"\b(?:test|dev|validation|dataset|set|split)\b")[0])
    name = F.regexp_replace(name, "[ .]+$", "")
    return F.when(F.length(name) >= 2, name)


def task_of(t: Column) -> Column:
    """What stands behind the first "for", up to a word that ends it; null below three characters."""
    name = F.trim(F.split(F.regexp_extract(t, r"(?i)for\s+([A-Z][A-Z0-9 -]{2,80})", 1), r"\b(?:on|using|with)\b")[0])
    return F.when(F.length(name) >= 3, name)


def range_spellings(low: Column, high: Column) -> Column:
    """The ways a range may stand in a text."""
    a, b = plain_number(low), plain_number(high)
    return F.array(*[F.concat(a, F.lit(x), b) for x in ("-", " - ", "–", " – ", " to ")])
