"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean expression over the text and its word count, with all that it needs computed in it. On a bounded sample each rule
is timed by itself and the share that it rejects is counted; the cascade tests the rules in the order of rejection per cost, as the
branches of one CASE, and so computes nothing of a rule behind the one that rejects. The verdict is the same in any order.

Defined results: a null text has no words and fails the rule `short`; an empty table keeps the rules' given order; of equal rejection
per cost the rule given first goes first; repeated rows are judged one by one; very long texts are read whole, in their own row (only the sample
leaves texts beyond SAMPLE_BYTES out); the input's other columns, of whatever name, are kept as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, let, read_table, row_columns, text_of, whole_row

#: Bounds of the sample that orders the rules: rows, and bytes of a text in it. It decides no verdict.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 14
#: The sample is taken of the texts whose hash this divides; of all texts where too few are found.
SAMPLE_ONE_IN = 16
#: Timed runs of each rule, of which the fastest counts.
PROBES = 3


@dataclass(frozen=True)
class Rule:
    """reject: from the text and its number of words to a boolean column."""

    name: str
    reject: Callable[[Column, Column], Column]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WS + "+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WS + "+", "")).cast("long")


def count_of(text: Column, signs: str) -> Column:
    """Characters of the class `signs`."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{signs}]", ""))).cast("long")


def lines_of(text: Column) -> Column:
    """n_lines with a word, and how many of them equal an earlier one: a struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def _windows(w: Column) -> Column:
    """A hash of each window of three words."""
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))


def _exact(w: Column, h: Column) -> Column:
    """Words that lie in a window found twice or more; where hashes meet, the windows themselves are compared."""
    rows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(h[i].alias("h"), F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("t"), i.alias("i"))))
    same = lambda a, b: (a["h"] == b["h"]) & (a["t"] == b["t"])
    twice = let(rows, lambda r: F.filter(r, lambda x, j: F.coalesce(same(x, F.get(r, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(r, j + 1)), F.lit(False))))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def word_counts(text: Column) -> Column:
    """n_words, word_chars and n_repeat_words (words in three-word windows found twice or more) of a text: a struct."""
    repeats = lambda w: let(_windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_exact(w, h)))
    return let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeats(w).cast("long").alias("n_repeat_words")),
    )


def mostly_repeats(text: Column, percent: int) -> Column:
    """n_repeat_words of word_counts() * 100 > n_words * percent. k windows beyond the first of their kind cover 6k words at most, which settles it for most texts without the exact count."""
    extra = lambda h: F.size(h) - F.size(F.array_distinct(h))
    test = lambda w: let(_windows(w), lambda h: F.when(extra(h) * 600 <= F.size(w) * percent, False).otherwise(_exact(w, h) * 100 > F.size(w) * percent))
    return let(words_of(text), test)


#: Thresholds of the production rules.
RULES = (
    Rule("short", lambda t, n: n < 50),
    Rule("repeats", lambda t, n: mostly_repeats(t, 50)),
    Rule("symbols", lambda t, n: count_of(t, "#*$%&|<>") * 10 > n),
    Rule("dup_lines", lambda t, n: let(lines_of(t), lambda x: x["n_dup_lines"] * 10 > x["n_lines"] * 3)),
    Rule("word_length", lambda t, n: let(word_chars(t), lambda c: (c < n * 2) | (c > n * 15))),
    Rule("exclamations", lambda t, n: (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) * 5 > n),
    Rule("capitals", lambda t, n: count_of(t, r"\p{Lu}") * 2 > word_chars(t)),
)


def measure(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """rule, seconds beyond an empty query's and rejected share, on at most sample_rows texts of at most SAMPLE_BYTES: the one thing that comes to the driver."""
    spark = docs.sparkSession
    texts = docs.select(text_of(text_col).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    rows = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0).limit(sample_rows).collect()
    if len(rows) < sample_rows:
        rows = texts.limit(sample_rows).collect()
    if not rows:
        return [{"rule": r, "seconds": 0.0, "rejected": 0.0} for r in rules]
    sample = spark.createDataFrame([(r[0],) for r in rows], "text string").coalesce(1)

    def timed(test: Column) -> tuple[float, float]:
        """Seconds of the fastest run, the first being a warm-up, and the share."""
        probe, best = sample.select(F.avg(F.coalesce(test, F.lit(False)).cast("double"))), float("inf")
        share = probe.first()[0]
        for _ in range(PROBES):
            began = time.perf_counter()
            probe.first()
            best = min(best, time.perf_counter() - began)
        return best, share

    n = n_words(F.col("text"))
    empty, _ = timed(n < 0)
    out = []
    for rule in rules:
        seconds, share = timed(rule.reject(F.col("text"), n))
        out.append({"rule": rule, "seconds": seconds - empty, "rejected": share})
    return out


def by_rejection_per_cost(measured: list[dict]) -> list[Rule]:
    """A rule that takes no measurable time counts as a millisecond."""
    return [x["rule"] for x in sorted(measured, key=lambda x: -x["rejected"] / max(x["seconds"], 1e-3))]


def cascade(text: Column, n: Column, ordered: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does. CASE evaluates a branch only where none before it holds."""
    out = None
    for rule in ordered:
        test = F.coalesce(rule.reject(text, n), F.lit(False))
        out = F.when(test, F.lit(rule.name)) if out is None else out.when(test, F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def _judged(docs: DataFrame, ordered: list[Rule], text_col: str) -> DataFrame:
    """row and rejected_by. The word count is bound by let(), as a filter on the verdict would have Spark put it into each branch."""
    text = text_of(text_col)
    return docs.select(whole_row(docs), let(n_words(text), lambda n: cascade(text, n, ordered)).alias("rejected_by"))


def judge(docs: DataFrame, rules=RULES, text_col: str = "text", verdict_col: str = "rejected_by") -> DataFrame:
    """docs with the name of the rule that rejects (null: kept). No shuffle."""
    if verdict_col in docs.columns:
        raise ValueError(f"the input has a column {verdict_col}; name another verdict_col")
    out = _judged(docs, by_rejection_per_cost(measure(docs, rules, text_col)), text_col)
    return out.select(*row_columns(docs), F.col("rejected_by").alias(verdict_col))


def quality_rules(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with docs' own columns."""
    out = _judged(docs, by_rejection_per_cost(measure(docs, rules, text_col)), text_col)
    return out.filter(F.col("rejected_by").isNull()).select(*row_columns(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract wants the base counts of every row, which settle four of the rules; the cascade then tests the others, and these by their counts."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.col("text")
    counted = docs.select("doc_id", text_of().alias("text"), word_counts(text_of()).alias("w"), count_of(text_of(), "#*$%&|<>").alias("n_symbols"), lines_of(text_of()).alias("lines"))
    counted = counted.select("doc_id", "text", "w.*", "n_symbols", "lines")
    n = F.col("n_words")
    known = {
        "repeats": F.col("n_repeat_words") * 100 > n * 50, "symbols": F.col("n_symbols") * 10 > n, "dup_lines": F.col("lines.n_dup_lines") * 10 > F.col("lines.n_lines") * 3,
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 15), "capitals": count_of(text, r"\p{Lu}") * 2 > F.col("word_chars"),
    }
    ordered = [Rule(r.name, lambda t, n, r=r: known[r.name]) if r.name in known else r for r in by_rejection_per_cost(measure(docs))]
    failed = (n < 50) | known["repeats"]
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.n_dup_lines").alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"),
        (~failed & cascade(text, n, ordered).isNull()).alias("kept"),
    )


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
f AS (SELECT doc_id, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (rid)),
g AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3
    OR word_chars < n_words * 2 OR word_chars > n_words * 15
    OR length(regexp_replace(text, '[^!]', '', 'g')) * 5 > n_words
    OR length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) * 2 > word_chars) AS kept
FROM g
"""
