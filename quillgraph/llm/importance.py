"""Resampling towards a target distribution by hashed n-gram features.

Words are runs of ASCII figures and letters (A-Z in lower case) and of all characters beyond ASCII; features are all runs of 1 to n of them, joined by one
space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo the number of buckets. A bucket's gain says how much more frequent it is in
the target than in all documents; a document's weight is the mean gain of its features. Documents are drawn without replacement by Gumbel scores.

Long texts are skewed work: they are cut at word boundaries into chunks of CHUNK_BYTES. A chunk owns the features that start in it and
carries the n - 1 words behind it, so every feature is counted once. Chunks are written, evenly dealt, and counts and weights are summed by document.
The driver sees a row for each bucket, and their gains go to the tasks: bounded by the number of buckets. Ranks come from ranges of the score, sorted, and a row for each range.

Defined results: a null text, or one without words, has no feature and weight 0, and is not drawn (it has fewer words than least_words); a very long text is read whole; a word
of any length is one word; rows with one doc_id are documents of their own (equal in score too, they stand in the order of reading), null ids come first among
equal scores; an empty table gives no rows, an empty target gains of an empty target's counts; ids may be of any type; other columns are not read.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_batches, materialize, read_table, release_memory, scratch_scope, text_of

N_GRAM = 2
BUCKETS = 10_000
CHUNK_BYTES = 1 << 16
LEAST_WORDS = 20
DRAWN_PERCENT = 25
SEED = 7

#: Bytes of words as themselves, A-Z in lower case, all others as blanks.
_TO_WORDS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def chunks_of(text: bytes, size: int, n: int):
    """(own, carry) of a text in words and blanks: the n - 1 words behind each chunk are carried with it."""
    behind = re.compile(rb" *(?:[^ ]+ *){0,%d}" % (n - 1))
    a = 0
    while a < len(text):
        b = text.find(b" ", a + size)
        b = len(text) if b < 0 else b
        yield text[a:b], behind.match(text, b).group() if n > 1 else b""
        a = b


def feature_buckets(own: bytes, carry: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of own words, and the buckets of all runs of up to n words that start at one of them."""
    words = own.split()
    k = len(words)
    words += carry.split()
    spaced = [b" " + w for w in words]
    crc, found = list(map(crc32, words)), []
    for size in range(1, n + 1):
        if size > 1:
            crc = list(map(crc32, spaced[size - 1 :], crc))
        found.append(np.array(crc[:k], np.uint32))
    return k, np.concatenate(found) % np.uint32(buckets)


def whole_and_chunks(docs: DataFrame, n: int = N_GRAM, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, own, carry) of texts of up to chunk_bytes, and of the chunks of the longer ones, which are written; key: the row of a long text."""
    byte_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("own"))
    short = source.filter(F.octet_length("own") <= chunk_bytes).select("doc_id", F.lit(None).cast("long").alias("key"), "own", F.lit(None).cast("binary").alias("carry"))
    long = source.filter(F.octet_length("own") > chunk_bytes).select("doc_id", F.monotonically_increasing_id().alias("key"), "own")

    def run(batches):
        for batch in batches:
            for k, text in enumerate(batch.column("own")):
                held, size = [], 0
                for piece in chunks_of(text.as_py().translate(_TO_WORDS), chunk_bytes, n):
                    held.append(piece)
                    size += len(piece[0])
                    if size >= 16 * chunk_bytes:
                        yield rows(batch, k, held)
                        held, size = [], 0
                if held:
                    yield rows(batch, k, held)
        release_memory()

    def rows(batch, k, held):
        one = [pa.repeat(batch.column(c)[k], len(held)) for c in ("doc_id", "key")]
        return pa.RecordBatch.from_arrays([*one, *(pa.array(x, pa.binary()) for x in zip(*held))], ["doc_id", "key", "own", "carry"])

    cut = long.mapInArrow(run, short.schema)
    return short, materialize(cut.hint("rebalance"), "text-chunks")


def bucket_counts(texts: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all texts: a task hands on one row for each bucket that it met."""

    def run(batches):
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for own, carry in zip(batch.column("own"), batch.column("carry")):
                seen += np.bincount(feature_buckets(own.as_py().translate(_TO_WORDS), carry.as_py() or b"", n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

    return texts.select("own", "carry").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """In thousandths of a natural logarithm, rounded down; counts are smoothed by one."""
    s, t = sum(raw.values()) + buckets, sum(target.values()) + buckets
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * float(s) / ((raw.get(b, 0) + 1) * float(t)))) for b in range(buckets)], np.int64)


def gain_sums(texts: DataFrame, gain: np.ndarray, n: int = N_GRAM) -> DataFrame:
    """doc_id, key, n_words, n_features, gain of each row of texts."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for own, carry in zip(batch.column("own"), batch.column("carry")):
                k, found = feature_buckets(own.as_py().translate(_TO_WORDS), carry.as_py() or b"", n, len(gain))
                out.append((k, len(found), int(gain[found].sum())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ())))], ["doc_id", "key", "n_words", "n_features", "gain"])
        release_memory()

    return texts.mapInArrow(run, f"doc_id {kind}, key bigint, n_words bigint, n_features bigint, gain bigint")


def importance_weights(docs: DataFrame, target: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs: the floored mean of its features' gains towards target's texts."""
    short, cut = whole_and_chunks(docs, n, id_col=id_col, text_col=text_col)
    counted = lambda parts: {r["bucket"]: r["n"] for r in bucket_counts(parts[0].unionByName(parts[1]), n, buckets).collect()}
    gain = gains(counted((short, cut)), counted(whole_and_chunks(target, n, id_col=target_id, text_col=text_col)), buckets)
    sums = ["n_words", "n_features", "gain"]
    of_long = gain_sums(cut, gain, n).groupBy("key", "doc_id").agg(*[F.sum(c).alias(c) for c in sums]).select("doc_id", *sums)
    both = gain_sums(short, gain, n).select("doc_id", *sums).unionByName(of_long)
    rest = F.pmod("gain", "n_features")
    weight = F.when(F.col("n_features") > 0, ((F.col("gain") - rest) / F.col("n_features")).cast("long")).otherwise(F.lit(0).cast("long"))
    return both.select("doc_id", "n_words", "n_features", weight.alias("weight"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A document's own chance, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, by: list[Column]) -> DataFrame:
    """rows with rank 1, 2, 3, ... in order. Ranges of the order are sorted apart; the window that numbers them sees a row for each range."""
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    sorted_rows = materialize(sorted_rows.withColumn("_range", F.shiftright("_place", 33)), "ranges", stays=True)
    size = sorted_rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = size.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_rows.join(before, "_range").withColumn("rank", F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_place", "_before")


def resample(weighted: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighted with score and rank: of the rows with at least least_words words, percent in a hundred are drawn, rounded down, those of the highest scores; rank is null of all others."""
    scored = weighted.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("_nth", F.monotonically_increasing_id())
    with scratch_scope(weighted.sparkSession):
        scored = materialize(scored, "scored", stays=True)
        able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
        placed = ranked(scored.filter(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_nth").asc()])
    drawn = scored.filter(able).count() * percent // 100
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))).drop("_nth")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = importance_weights(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return resample(weighted).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by a table of 256 entries, which the rule of its polynomial fills; bytes of distinct features only.
OP12_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)::BIGINT AS c FROM (SELECT unnest(range(256)) AS b))),
w AS (SELECT 'd' AS side, row_number() OVER () AS key, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT side, key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
d AS (SELECT DISTINCT f FROM f),
h AS (SELECT f, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT) AS bytes FROM d),
c AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, tab[1 + xor(c % 256, x)])), 4294967295) % 10000 AS bucket FROM h, tab),
n AS MATERIALIZED (SELECT side, key, bucket, count(*) AS n FROM f JOIN c USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM n),
g AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (side = 'b'), 0) + 1)::DOUBLE * (max(s) + 10000) / ((coalesce(sum(n) FILTER (side = 'd'), 0) + 1)::DOUBLE * (max(t) + 10000))))::BIGINT AS gain FROM n, totals GROUP BY bucket),
m AS (SELECT key, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE side = 'd' GROUP BY key),
v AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (key) WHERE side = 'd'),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM v),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank, count(*) OVER () * 25 // 100 AS drawn FROM s WHERE words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
