"""Relations from dependency trees: patterns over a verb, its subject or object and a further object, the phrases below them, numbers with their units, and the metric near a number.

A parser is a provider; its tokens come as rows. A sentence's tokens meet in one row, which a sentence bounds; there each token has the range of its subtree (the first and last
token below it), so a phrase is a slice, and its children, by which patterns, which are data, are matched within the row. One shuffle, by sentence, and none where the tokens are dealt by
sentence already. Ranges and children are a small Python helper's, linear in the tokens: as expressions they need a look at each pair of tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.kinds import phrase_kinds
from quillgraph.functions.text import collapse


@dataclass(frozen=True)
class Pattern:
    """A verb, a noun below it, and an object below the verb or below one of its prepositions."""

    rule: str
    verbs: tuple[str, ...]
    noun_deps: tuple[str, ...]
    preps: tuple[str, ...]
    object_deps: tuple[str, ...]
    noun_object: bool = True


#: The patterns, by lemmas and kinds of dependency.
NOUNS = ("NOUN", "PROPN")
_TESTED, _SUBJECT, _BELOW_PREP = ("evaluate", "test", "assess", "train"), ("nsubj", "nsubjpass"), ("pobj", "dobj")
PATTERNS = [
    Pattern("PROPOSES", ("propose", "introduce", "present", "develop"), ("dobj", "obj", "attr"), ("for", "to"), _BELOW_PREP),
    Pattern("EVALUATED_ON", _TESTED, _SUBJECT, ("on",), _BELOW_PREP),
    Pattern("EVALUATED_ON", _TESTED, ("dobj", "obj"), ("on",), _BELOW_PREP),
    Pattern("REPORTS", ("achieve", "obtain", "reach", "record", "report", "attain", "yield"), _SUBJECT, (), ("dobj", "attr", "oprd"), False),
]
#: What may follow a number, and what names a metric near it.
UNIT_TOKENS = ["%", "percent", "percentage", "points", "pts"]
METRICS = ["accuracy", "f1", "f1-score", "precision", "recall", "bleu", "rouge", "auc", "map", "mrr", "psnr", "dice", "iou", "wer", "cer"]
METRIC_REACH = 6
#: In hundredths: of a rule, of a number with its metric, and without.
RULE, WITH_METRIC, WITHOUT_METRIC = 72, 68, 64


def below(heads: list) -> tuple:
    """First and last place of the subtree of each place, and its children. heads: the parent of each place, None at a root; places of a ring have all that hangs from it."""
    n = len(heads)
    left, right, children = list(range(n)), list(range(n)), [[] for _ in range(n)]
    for i, h in enumerate(heads):
        if h is not None:
            children[h].append(i)
    open_ = [len(c) for c in children]
    ready = [i for i in range(n) if not open_[i]]
    for i in ready:  # grows: a place whose children are through
        if (h := heads[i]) is not None:
            left[h], right[h] = min(left[h], left[i]), max(right[h], right[i])
            open_[h] -= 1
            if not open_[h]:
                ready.append(h)
    for i in range(n):
        ring = []
        while open_[i]:
            open_[i] = 0
            ring.append(i)
            i = heads[i]
        if ring:
            lo, hi = min(left[a] for a in ring), max(right[a] for a in ring)
            for a in ring:
                left[a], right[a] = lo, hi
    return left, right, children


def sentence_trees(tokens: DataFrame, doc: str) -> DataFrame:
    """doc, t: its tokens in order, below: left and right (first and last place of the subtree) and children of each token, and three texts with a letter a token: numbers (n number, u unit, o "to", s space, x), nouns (a adjective,
    n noun, x) and metrics (m, x). tokens: doc, i (from 0, no gaps), start, word, lemma, pos, dep, head (place of the parent; null or itself at the root), like_num."""
    own = F.array_sort(F.collect_list(F.struct("i", "start", "word", F.lower("lemma").alias("lemma"), "pos", "dep", F.when(F.col("head") != F.col("i"), F.col("head")).alias("head"), "like_num")))
    rows = tokens.groupBy(doc).agg(own.alias("t"))
    tree = F.udf(below, "left array<int>, right array<int>, children array<array<int>>", useArrow=True)
    low = lambda x: F.lower(x["word"])
    number = lambda x: F.when(F.trim(x["word"]) == "", "s").when(x["like_num"], "n").when(low(x).isin(UNIT_TOKENS), "u").when(low(x) == "to", "o").otherwise("x")
    noun = lambda x: F.when(x["pos"] == "ADJ", "a").when(x["pos"].isin(*NOUNS), "n").otherwise("x")
    metric = lambda x: F.when(x["lemma"].isin(METRICS) | low(x).isin(METRICS), "m").otherwise("x")
    letters = [F.array_join(F.transform("t", f), "").alias(c) for c, f in (("numbers", number), ("nouns", noun), ("metrics", metric))]
    return rows.select(doc, "t", tree(F.transform("t", lambda x: x["head"])).alias("below"), *letters)


def pattern_matches(trees: DataFrame, patterns: list[Pattern] = PATTERNS) -> DataFrame:
    """trees with rule, verb, noun, object (places) of each match; the same tokens under two patterns of a rule are two matches."""
    words = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    data = F.array(*[F.struct(F.lit(p.rule).alias("rule"), words(p.verbs).alias("verbs"), words(p.noun_deps).alias("noun_deps"), words(p.preps).alias("preps"), words(p.object_deps).alias("object_deps"), F.lit(p.noun_object).alias("noun_object")) for p in patterns])
    t, p, all_places = F.col("t"), F.col("p"), F.transform("t", lambda x: x["i"])
    of = lambda parent, fits: F.filter(F.col("below.children")[parent], lambda j: fits(t[j]))
    named = lambda x: x["pos"].isin(*NOUNS)
    has = lambda name, value: F.array_contains(p[name], value)
    m = trees.withColumn("p", F.explode(data))
    m = m.withColumn("verb", F.explode(F.filter(all_places, lambda j: has("verbs", t[j]["lemma"]))))
    m = m.withColumn("noun", F.explode(of(F.col("verb"), lambda x: has("noun_deps", x["dep"]) & named(x))))
    # without a preposition the object hangs from the verb
    m = m.withColumn("by", F.explode(F.when(F.size("p.preps") == 0, F.array("verb")).otherwise(of(F.col("verb"), lambda x: (x["dep"] == "prep") & has("preps", x["lemma"])))))
    m = m.withColumn("object", F.explode(of(F.col("by"), lambda x: has("object_deps", x["dep"]) & (named(x) | ~p["noun_object"]))))
    return m.withColumn("rule", F.col("p.rule")).drop("p", "by")


def _span(first: Column, last: Column) -> Column:
    """Offsets from the start of one token to the end of another."""
    return F.struct(F.col("t")[first]["start"].alias("start"), (F.col("t")[last]["start"] + F.length(F.col("t")[last]["word"])).alias("end"))


def phrase(text: Column, span: Column) -> Column:
    """Without bracket citations, a leading article and outer signs."""
    raw = F.substring(text, span["start"] + 1, span["end"] - span["start"])
    plain = F.regexp_replace(collapse(F.regexp_replace(raw, r"\[[^\]]+\]", " ")), r"(?i)^(?:the|a|an)\s+", "")
    clean = F.regexp_replace(plain, "^[ ,.;:]+|[ ,.;:]+$", "")
    return F.when(clean == "", F.regexp_replace(raw, r"^\s+|\s+$", "")).otherwise(clean)


def with_phrases(matches: DataFrame, sentences: DataFrame, doc: str) -> DataFrame:
    """doc, rule, verb (lemma), subject, subject_span, object, object_span, object_type, conf (hundredths) of each match. sentences: doc, text.

    A number takes the numbers, units and ranges ("to" before a number) behind it; the first metric within METRIC_REACH tokens of it, with the nouns around, stands before it."""
    m = matches.join(sentences.select(doc, "text"), doc)
    at = F.col("object")
    tail = F.regexp_extract(F.substring("numbers", at + 2, F.length("numbers")), "^(?:[nus]|on)*", 0)
    value = _span(at, at + F.length(F.regexp_replace(tail, "s+$", "")))
    first = F.greatest(at - METRIC_REACH, F.lit(0))
    found = F.locate("m", F.substring("metrics", first + 1, at + METRIC_REACH + 1 - first))
    place = first + found - 1
    before, behind = F.regexp_extract(F.substring("nouns", F.lit(1), place), "[an]*$", 0), F.regexp_extract(F.substring("nouns", place + 2, F.length("nouns")), "^n*", 0)
    metric = F.when(found > 0, _span(place - F.length(before), place + F.length(behind)))
    whole = lambda x: _span(F.col("below.left")[x], F.col("below.right")[x])
    reports = F.col("rule") == "REPORTS"
    m = m.select(doc, "rule", F.col("t")[F.col("verb")]["lemma"].alias("verb"), "text", whole(F.col("noun")).alias("subject_span"), F.when(reports, value).otherwise(whole(at)).alias("own"), F.when(reports, metric).alias("metric"))
    told = F.concat_ws(" ", F.when(F.col("metric").isNotNull(), phrase(F.col("text"), F.col("metric"))), phrase(F.col("text"), F.col("own")))
    both = F.struct(F.least("own.start", "metric.start").alias("start"), F.greatest("own.end", "metric.end").alias("end"))
    kind = F.when(F.col("metric").isNotNull(), "Metric").when(F.col("rule") == "PROPOSES", "Task").when(F.col("rule") == "EVALUATED_ON", "Dataset").otherwise("Concept")
    conf = F.when(F.col("rule") != "REPORTS", RULE).when(F.col("metric").isNotNull(), WITH_METRIC).otherwise(WITHOUT_METRIC)
    return m.select(doc, "rule", "verb", phrase(F.col("text"), F.col("subject_span")).alias("subject"), "subject_span", told.alias("object"), both.alias("object_span"), kind.alias("object_type"), conf.alias("conf"), phrase(F.col("text"), F.col("own")).alias("value"))


def dependency_candidates(tokens: DataFrame, sentences: DataFrame, doc: str) -> DataFrame:
    """Matches whose subject looks like a method and whose object looks like what its rule wants."""
    m = with_phrases(pattern_matches(sentence_trees(tokens, doc)), sentences, doc)
    looks = lambda c, kind: phrase_kinds(F.col(c))[kind]
    fits = F.when(F.col("rule") == "PROPOSES", looks("object", "task")).when(F.col("rule") == "EVALUATED_ON", looks("object", "dataset")).otherwise(looks("value", "value"))
    return m.filter(looks("subject", "method") & fits).drop("value")
