"""Which terms, labels, aliases and lines carry no information, and which labels fit their type. Boolean expressions that stay in the JVM; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import EDGES, collapse, sanitize

#: Terms that name nothing.
LOW_INFO_TERMS = [
    "it", "its", "itself", "they", "them", "theirs", "themselves", "we", "us", "our", "ours", "ourselves", "this", "that", "these", "those",
    "the work", "the paper", "our paper", "the authors", "the method", "the model", "the approach", "the system", "the framework", "the technique", "the algorithm", "the pipeline", "the study",
    "proposed method", "proposed model", "proposed approach",
]
#: What names nothing before one of the base terms, and these, which name nothing alone either.
LOW_INFO_PREFIXES = ["this", "that", "these", "those", "our", "their", "its", "the proposed", "the presented", "the aforementioned", "such"]
LOW_INFO_BASE_TERMS = ["method", "model", "approach", "system", "framework", "technique", "algorithm", "pipeline", "architecture", "study", "work"]
#: Words of which a journal's abbreviation consists.
CITATION_TOKENS = ["acta", "adv", "conf", "ieee", "int", "j", "lett", "letters", "nat", "phys", "proc", "rev", "symp", "trans"]
#: What names a metric, and what may stand behind its value (anywhere in the text).
METRIC_KEYWORDS = [
    "accuracy", "f1", "f-score", "f score", "precision", "recall", "bleu", "bleu score", "rouge", "wer", "word error rate", "error rate", "error", "loss", "perplexity", "auc", "auroc", "auprc", "psnr", "ssim", "mse", "rmse",
    "mae", "map", "mean average precision", "dice", "iou", "exact match", "top-1", "top 1", "top-5", "top 5", "cer", "mrr", "hit@1", "hit@5",
]
VALUE_UNITS = ["%", "percent", "percentage", "points", "score", "db", "ms", "s", "sec", "second", "seconds", "minute", "minutes", "hour", "hours", "fps", "flops", "params", "parameters", "samples", "epochs", "iterations"]
#: What a sentence in place of a name begins with, and its verbs.
SENTENCE_STARTS = ["we", "our", "this", "that", "these", "those"]
REPORTING_VERBS = ["observe", "achieve", "report", "propose", "introduce", "improve", "show", "demonstrate", "evaluate"]
#: Aliases that are noise, and what such ones begin with.
NOISE_ALIASES = ["in table", "table", "at less than 1/", "less than 1/", "big model", "big transformer model"]
NOISE_STARTS = ["see", "our", "their", "its", "this", "that", "these", "those"]
RESULT_STARTS = ["these", "those", "our", "the"]
NUMERALS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
#: Tokens of a tokenizer that a text may show, words that begin a caption, what a picture of attention is called, titles of appendices.
SPECIAL_TOKENS = ["<pad>", "<s>", "</s>", "<bos>", "</bos>", "<eos>", "</eos>", "<unk>", "</unk>", "[cls]", "[sep]", "[pad]"]
CAPTION_WORDS = ["fig", "figure", "tab", "table"]
ATTENTION_WORDS = ["map", "maps", "weight", "weights", "head", "heads", "visualization", "visualizations", "heatmap", "heatmaps"]
ATTENTION_SIGNS = ["visualization", "heatmap", "matrix", "weights", "head"]
APPENDIX_WORDS = ["appendix", "supplement", "supplementary"]


def _any(words) -> str:
    """One of the words, as a pattern."""
    return "|".join(words)


def _text(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def _has_any(t: Column, parts) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(t, p))


def _starts(t: Column, words) -> Column:
    """With one of the words and a space."""
    return t.rlike(f"^(?:{_any(words)}) ")


def low_info(t: Column) -> Column:
    """Nothing, a term that names nothing, or a base term alone or behind one of the prefixes."""
    n = F.lower(collapse(_text(t)))
    return (n == "") | n.isin(LOW_INFO_TERMS + LOW_INFO_BASE_TERMS) | n.rlike(f"^(?:{_any(LOW_INFO_PREFIXES)}) (?:{_any(LOW_INFO_BASE_TERMS)})$")


def good_label(t: Column) -> Column:
    """Two ASCII letters at least, 35 % of all letters and figures, more of them than of signs (but - _ /), and not only words of journals' abbreviations."""
    t = _text(t)
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))
    letters, other, signs = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")), F.regexp_count(t, F.lit(r"[\p{Punct}&&[^_/-]]"))
    cites = F.forall(words, lambda w: w.isin(CITATION_TOKENS))
    return ~low_info(t) & ~cites & (letters >= F.greatest(F.lit(2), F.floor(other * F.lit(0.35)))) & (letters > signs)


def _forms(verb: str) -> str:
    return f"{verb[:-1]}(?:e|ed|es|ing)" if verb.endswith("e") else f"{verb}(?:ed|s|ing)?"


def fits_type(t: Column, kind: Column) -> Column:
    """A good label that as a metric names one or has a figure and a unit, and as a dataset or task does not begin like a sentence or hold a reporting verb."""
    low, kind = F.lower(_text(t)), F.lower(collapse(_text(kind)))
    metric = _has_any(low, METRIC_KEYWORDS) | (low.rlike(r"\p{Nd}") & _has_any(low, VALUE_UNITS))
    named = ~_starts(F.regexp_replace(low, EDGES, ""), SENTENCE_STARTS) & ~low.rlike(rf"\b(?:{_any(map(_forms, REPORTING_VERBS))})\b")
    return good_label(t) & F.when(kind == "metric", metric).when(kind.isin("dataset", "task"), named).otherwise(True)


def noise_alias(t: Column) -> Column:
    """Empty, one of the noise aliases, a pointer, a reference to a table, figure or appendix, an alternative, a phrase about results, or up to three words in small letters of which the first is a numeral."""
    text = F.regexp_replace(_text(t), EDGES, "")
    low = F.lower(text)
    counted = (text == low) & text.rlike(rf"^(?:{_any(NUMERALS)})(?:\s+\p{{L}}+){{0,2}}$")
    about = F.contains(low, F.lit("results")) & _starts(low, RESULT_STARTS)
    placed = F.contains(low, F.lit("appendix")) | low.rlike(r"\b(?:table|figure)\s+\p{Nd}+")
    return (text == "") | low.isin(NOISE_ALIASES) | _starts(low, NOISE_STARTS) | placed | about | F.contains(low, F.lit(" or ")) | counted


def noise_line(line: Column, title: Column | None = None) -> Column:
    """A blank line, a caption, a layer's name, the legend of a picture of attention, or figures without a letter. A section about attention, or an appendix, has more such legends."""
    low = F.regexp_replace(F.lower(_text(line)), EDGES, "")
    title = F.lower(_text(F.lit(None).cast("string") if title is None else title))
    caption = low.rlike(rf"^(?:{_any(CAPTION_WORDS)})\s+[\p{{L}}\p{{N}}_-]")
    pictured = low.rlike(rf"\battention\b.*\b(?:{_any(ATTENTION_WORDS)})\b")
    shown = F.contains(title, F.lit("attention")) | title.rlike(rf"\b(?:{_any(APPENDIX_WORDS)})\b") | _has_any(low, ATTENTION_SIGNS) | (F.regexp_count(low, F.lit("attention")) > 1)
    return (low == "") | caption | low.rlike(r"input-?input\s+layer") | (pictured & shown) | (low.rlike(r"\p{Nd}") & ~low.rlike(r"\p{L}"))


def without_noise_lines(t: Column, title: Column | None = None) -> Column:
    """The lines of a text that are no noise, without control characters and outer white space; lines that show special tokens go as well."""
    lines = F.filter(F.split(_text(t), r"\r\n|[\n\r\x0B\f]"), lambda x: ~_has_any(F.lower(x), SPECIAL_TOKENS))
    return F.array_join(F.filter(F.transform(lines, lambda x: F.coalesce(sanitize(x), F.lit(""))), lambda x: ~noise_line(x, title)), "\n")


def edge_summary(relation: Column, metric: Column, value: Column, unit: Column, dataset: Column, task: Column, claim: Column, verified: Column) -> Column:
    """A sentence about an edge; null of a refuted or empty one."""
    tail = F.coalesce(F.concat(F.lit(" on "), dataset), F.concat(F.lit(" for "), task), F.lit(""))
    measured = F.concat(F.coalesce(metric, F.lit("Metric")), F.coalesce(F.concat(F.lit(" "), value, F.coalesce(unit, F.lit(""))), F.lit("")), tail)
    said = (
        F.when(relation == "reports", measured).when(relation == "evaluates_on", F.concat(F.lit("Evaluated on "), dataset)).when(relation == "proposes", F.concat(F.lit("Targets "), task))
        .when(relation == "compares", F.concat(F.lit("Comparison on "), dataset, F.lit(" ("), F.coalesce(metric, F.lit("performance")), F.lit(")")))
    )
    return F.when(F.coalesce(verified, F.lit(True)), F.coalesce(F.concat(claim, F.lit(" - "), said), said))


def span_in(text: Column, start: Column, end: Column, mention: Column) -> Column:
    """The span within the text: clamped where it is one, else where the mention stands first, else null."""
    n = F.length(text)
    a, b = F.least(F.greatest(start, F.lit(0)), n), F.least(F.greatest(end, F.lit(0)), n)
    at = F.position(mention, text)
    return F.when(a < b, F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))).when(at > 0, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(mention)).cast("int").alias("end")))


def display_phrase(t: Column) -> Column:
    """Hyphens as spaces, white space collapsed, capitals where there are none."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(t, "-", " "), r"\s+", " "))
    return F.when(flat == F.lower(flat), F.initcap(flat)).otherwise(flat)


def plain_phrase(t: Column) -> Column:
    """Without bracket citations and a leading article."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(t, r"\[[0-9, ]+\]", ""), r"\s+", " ")), "(?i)^(?:a|an|the) ", "")


def target_kind(relation: Column) -> Column:
    """What a relation's target is where nothing names its type."""
    return F.when(relation == "reports", "metric").when(relation == "proposes", "task").when(relation == "evaluates_on", "dataset").when(relation.isin("uses", "compares"), "method").otherwise("concept")
