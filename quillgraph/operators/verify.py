"""Evidence checks: where a quotation stands, what a pronoun refers to, which table cell holds a value, nested aliases."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillgraph.functions import text as X

LEAST_BLOCK, BLOCK_SHARE, LEAST_RATIO = 5, 0.6, 0.75
#: What text.number_spellings() may give of a finite number: no leading zeros, four decimals at most without trailing zeros, a per cent sign perhaps.
SPELLING = r"^-?(?:0|[1-9][0-9]*)(?:[.,][0-9]{0,3}[1-9])?(?: ?%)?$"


def near_span(sentence: str | None, quote: str | None) -> dict | None:
    """Longest common block of at least 5 characters and 60 % of the quote, if the texts are 75 % alike; null otherwise."""
    if not sentence or not quote:
        return None
    m = difflib.SequenceMatcher(None, sentence.lower(), quote.lower())
    if m.real_quick_ratio() < LEAST_RATIO or m.quick_ratio() < LEAST_RATIO:
        return None
    b = m.find_longest_match()
    alike = b.size >= max(LEAST_BLOCK, int(len(quote) * BLOCK_SHARE)) and m.ratio() >= LEAST_RATIO
    return {"start": b.a, "end": b.a + b.size} if alike else None


def _near(sentence: pd.Series, quote: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([near_span(s, q) or {} for s, q in zip(sentence, quote)], columns=["start", "end"], dtype="Int32")


def _flat(raw: pd.Series) -> pd.Series:
    return pd.Series([alias_values(x) for x in raw], dtype=object)


def may_be_near(sentence: Column, quote: Column) -> Column:
    """False only where near_span() is null, without a look at the alignment.

    A common block of k characters, as near_span() wants it, holds one of the quote's parts of (k + 1) / 2 characters that begin at every multiple of that length;
    and a ratio bounds how much longer one text may be than the other.
    """
    low, wanted = F.lower(sentence), F.lower(quote)
    k = F.greatest(F.lit(LEAST_BLOCK), F.floor(F.length(quote) * F.lit(BLOCK_SHARE)).cast("int"))
    size = F.floor((k + 1) / 2).cast("int")
    starts = F.when(F.length(wanted) >= k, F.sequence(F.lit(0), F.length(wanted) - size, size)).otherwise(F.array().cast("array<int>"))
    alike = F.least(F.length(low), F.length(wanted)) * 2 >= (F.length(low) + F.length(wanted)) * F.lit(LEAST_RATIO)
    return alike & F.exists(starts, lambda i: F.contains(low, F.substring(wanted, i + 1, size)))


def evidence_pairs(claims: DataFrame, sentences: DataFrame, paper: str, claim_id: str, order: str) -> DataFrame:
    """Claims with the sentences of their paper: at (place of an exact copy, 0 without one), and near (a near match is possible)."""
    pairs = claims.filter("trim(quote) <> ''").join(sentences.select(paper, order, "sentence"), paper)
    pairs = pairs.withColumn("at", F.expr("locate(lower(trim(quote)), lower(sentence))"))
    return pairs.withColumn("near", (F.col("at") == 0) & F.coalesce(may_be_near(F.col("sentence"), F.trim("quote")), F.lit(False)))


def match_evidence(claims: DataFrame, sentences: DataFrame, paper: str, claim_id: str, order: str) -> DataFrame:
    """First sentence of the paper that holds the claim's quote, and where; a near match only in sentences that do not hold it.

    claims: paper, claim_id, quote. sentences: paper, order, sentence. A claim meets the sentences of its own paper by an equi-join; only those
    that have a part of the quote, which stays in the JVM, are aligned, in Arrow batches. Claims without a match are left out.
    """
    pairs = evidence_pairs(claims, sentences, paper, claim_id, order)
    hit = pairs.filter("at > 0").select(paper, claim_id, order, (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length(F.trim("quote"))).alias("end"), F.lit(False).alias("fuzzy"))
    near = pairs.filter("near").withColumn("n", pandas_udf(_near, "start int, end int")("sentence", F.trim("quote"))).filter("n.start IS NOT NULL").select(paper, claim_id, order, "n.start", "n.end", F.lit(True).alias("fuzzy"))
    best = hit.unionByName(near).groupBy(paper, claim_id).agg(F.min(F.struct(order, "start", "end", "fuzzy")).alias("m"))
    return best.select(paper, claim_id, "m.*")


def evidence_candidates(claims: DataFrame, sentences: DataFrame, paper: str, claim_id: str, order: str) -> DataFrame:
    """For each claim the sentences of its paper, those that hold its quote, and those that are aligned."""
    pairs = evidence_pairs(claims, sentences, paper, claim_id, order)
    return pairs.groupBy(paper, claim_id).agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.col("at") > 0).alias("exact"), F.count_if("near").alias("aligned"))


def resolve_references(mentions: DataFrame, section: str, order: str, kind: str, value: str, needs: str) -> DataFrame:
    """What each reference stands for: the last value of its kind in the section, else the last of the kind seen first there; a resolved
    reference then counts as a value of its own kind.

    Because what re-enters is always a value seen before, the fold over a section has a closed form in windows: a reference takes the last
    real value of its kind, and where none came yet, what the first resolvable reference of that kind fell back on. Null if nothing precedes.
    """
    before = Window.partitionBy(section).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    by_kind = Window.partitionBy(section, kind).orderBy(order)
    real = F.when(~F.col(needs), F.col(value))
    lead = Window.partitionBy(section).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = mentions.withColumn("_lead", F.first(F.when(~F.col(needs), F.col(kind)), ignorenulls=True).over(lead))
    m = m.withColumn("_fall", F.last(F.when(F.col(kind) == F.col("_lead"), real), ignorenulls=True).over(before))
    m = m.withColumn("_own", F.last(real, ignorenulls=True).over(by_kind.rowsBetween(Window.unboundedPreceding, -1)))
    fallen = F.first(F.when(F.col(needs) & F.col("_own").isNull(), F.col("_fall")), ignorenulls=True).over(by_kind.rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("antecedent", F.when(F.col(needs), F.coalesce("_own", fallen))).drop("_lead", "_fall", "_own")


def look_back(sentences: DataFrame, doc: str, order: str, candidate: Column, reach: int = 5) -> DataFrame:
    """The candidate of the nearest of the `reach` sentences before that has one."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(-reach, -1)
    return sentences.withColumn("antecedent", F.last(candidate, ignorenulls=True).over(w))


def table_matches(measures: DataFrame, cells: DataFrame, section: str, measure_id: str, longest: int = 24) -> DataFrame:
    """For each measure (section, value) the first cell (section, table_id, row, col, cell) with one of the value's spellings in it.

    A spelling is made of figures, signs, points and per cents, so it stands within a run of these; the parts of the runs meet the spellings in
    an equi-join on (section, spelling). No measure is paired with a cell that does not hold it. Parts have up to `longest` characters:
    a spelling of a double with four decimals has fewer up to 10^16. Only parts in the form of a spelling (SPELLING), each once a cell, are rows.
    """
    runs = F.filter(F.regexp_extract_all("cell", F.lit(r"[0-9.,%\- ]+"), F.lit(0)), lambda x: x.rlike("[0-9]"))

    def spelled_parts(run: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(run))
        of = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(run) - i + 1)), lambda k: F.substring(run, i, k))
        begins = F.filter(places, lambda i: F.substring(run, i, F.lit(1)).rlike("[0-9-]"))
        return F.flatten(F.transform(begins, lambda i: F.filter(of(i), lambda x: x.rlike(SPELLING))))

    parts = cells.select(section, "table_id", "row", "col", F.explode(F.array_distinct(F.flatten(F.transform(runs, spelled_parts)))).alias("part"))
    first = parts.groupBy(section, "part").agg(F.min(F.struct("table_id", "row", "col")).alias("at"))
    spelled = measures.select(section, measure_id, F.explode(X.number_spellings(F.col("value"))).alias("part"))
    found = spelled.join(first, [section, "part"]).groupBy(section, measure_id).agg(F.min("at").alias("at"))
    return found.select(section, measure_id, "at.*")


def alias_values(raw: str | None) -> list[str]:
    """Texts of a plain string or a nested JSON value, level by level; a list of single characters is one text. First spelling of each, without regard to case."""
    raw = (raw or "").strip()
    try:
        level = [json.loads(raw)] if raw[:1] in ("[", "{") else [raw]
    except ValueError:
        level = [raw]
    found: list[str] = []
    while level:
        deeper = []
        for x in level:
            if isinstance(x, dict):
                deeper += x.values()
            elif isinstance(x, list):
                words = [w for w in (" ".join(v.split()) for v in x if isinstance(v, str)) if w]
                found += ["".join(words)] if words and max(map(len, words)) == 1 else words
                deeper += [v for v in x if not isinstance(v, str)]
            elif x is not None:
                found.append(" ".join(str(x).split()))
        level = deeper
    first: dict[str, str] = {}
    for w in filter(None, found):
        first.setdefault(w.casefold(), w)
    return list(first.values())


def flat_aliases(raw: Column) -> Column:
    """alias_values as an Arrow UDF."""
    return pandas_udf(_flat, "array<string>")(raw)


def tier_counters(candidates: DataFrame, **conditions: Column) -> DataFrame:
    """Counters of an extraction run: all rows and those for which each condition holds, in one pass."""
    return candidates.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def first_spelling(rows: DataFrame, group: list[str], text: str, order: str) -> DataFrame:
    """Texts of each group without regard to case and outer spaces, in the spelling that comes first."""
    key = F.lower(F.trim(text))
    return rows.filter(key != "").groupBy(*group, key.alias("key")).agg(F.min_by(F.trim(text), order).alias(text))


def best_spelling(rows: DataFrame, key: list[str], text: str, score: str) -> DataFrame:
    """The text of the highest score of each key; of equal scores the first in order of text."""
    return rows.groupBy(*key).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(text).alias("t"))).alias("b")).select(*key, F.col("b.t").alias(text), (-F.col("b.s")).alias(score))


def first_kind(names: DataFrame, dimensions: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each name the first dimension (kind, table of id and name) that has it: one union and one join, not a join for each kind."""
    all_rows = None
    for i, (kind, d) in enumerate(dimensions):
        rows = d.select(F.lower(F.trim("name")).alias("k"), F.struct(F.lit(i).alias("rank"), F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind")).alias("hit"))
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    best = all_rows.groupBy("k").agg(F.min("hit").alias("hit"))
    return names.withColumn("k", F.lower(F.trim("name"))).join(best, "k", "left").select("name", "hit.kind", "hit.id")
