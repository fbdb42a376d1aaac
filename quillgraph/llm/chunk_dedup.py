"""Substring dedup by content-defined chunking.

A gear rolling hash of the preceding WINDOW bytes decides at each word start (in scripts without spaces, and in words beyond
LONG_WORD bytes, at each character) whether a chunk begins there. Both that and the rule for the least length look at near bytes only, so an
insertion moves boundaries no further than itself, and equal passages fall into equal pieces wherever they stand.
A chunk is SPAN pieces in a row, and one begins at each piece, so that chunks overlap: they are long enough not to be
equal by chance, and the ends of a passage are found to a piece.
Chunks are known by a BLAKE2b digest of 112 bits. Of equal chunks the first of the smallest doc_id stays, whole, also where repeated ones overlap it: so each chunk that
texts have in common still stands in one of them. What is left of a run of repeated chunks of MIN_WORDS words or more is cut out, where a run counts as a word for each WORD_CHARS
characters at least: so the measure holds for scripts without spaces too. A passage below it is no repeat.

A passage of 50 words keeps MIN_WORDS words and more in whole chunks (its ends lie in pieces that reach beyond it), while
phrases that texts have in common by chance are shorter. Counts are taken map-side, of prints first; hot digests are split in the
join; only texts of documents that may lose something are shuffled.

Defined results: a null text is empty and has no chunk; of repeated rows with one doc_id and text all are the first; of texts with one doc_id
that with the smallest hash is; null ids come last; very long texts are read whole, in their own row; an empty table gives no rows; ids may have any type that can be
ordered; other columns, of whatever name, are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, materialize, part_by_keys, read_table, release_memory, release_shuffles, row_columns, salted_join, scratch_scope, text_of, thin, whole_row

WINDOW = 16
#: A word start begins a piece with chance 1 / WORDS, unless another drawn one lies less than LEAST_BYTES before it.
WORDS = 3
LEAST_BYTES = 8
#: Pieces of a chunk: some 11 words.
SPAN = 3
MIN_WORDS = 20
WORD_CHARS = 8
LONG_WORD = 64
AT_A_TIME = 1 << 20
#: A digest is 64 bits, which serve as its print, and these.
REST_BITS = 48
DIGEST = ["print", "rest"]

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def chunk_starts(raw: np.ndarray) -> np.ndarray:
    """Offsets of the pieces of a text's bytes; the first is 0. An empty text has none."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    h, step = _GEAR[raw], 1
    while step < WINDOW:  # sums of 1, 2, 4, 8, 16 bytes, each older one shifted
        h = h.copy()
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    blank = _BLANK[raw]
    start = np.zeros(n, bool)
    start[1:] = blank[:-1] & ~blank[1:]
    wide = np.flatnonzero(raw >= 0xE3)  # lead bytes of scripts that use no spaces; the byte before ends such a character too
    wide = wide[wide >= 3]
    start[wide[raw[wide - 3] >= 0xE3]] = True
    # in words of no end, such as encoded data: characters that have no white space within LONG_WORD bytes before them
    last_blank = np.maximum.accumulate(np.where(blank, np.arange(n), -1))
    inside = np.arange(n) - last_blank > LONG_WORD
    start[inside & ((raw & 0xC0) != 0x80)] = True
    at = np.flatnonzero(start)
    drawn = at[(h[at - 1] >> np.uint32(8)) % np.uint32(WORDS) == 0]
    drawn = drawn[np.diff(drawn, prepend=-LEAST_BYTES) >= LEAST_BYTES]
    return np.append(0, drawn[drawn > 0])


def chunk_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of a text's bytes; the last one ends with the text."""
    at = chunk_starts(raw)
    if not len(at):
        return at, at
    end = np.append(at[1:], len(raw))
    last = max(1, len(at) - SPAN + 1)
    return at[:last], end[min(SPAN, len(at)) - 1 :]


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def _cut(batch: pa.RecordBatch):
    """(row, starts, ends, digests) of each text of a batch, of about AT_A_TIME bytes of text at a time."""
    own, size = [], 0
    for i, text in enumerate(batch.column("text")):
        text = text.as_py()
        at, end = chunk_spans(np.frombuffer(text, np.uint8))
        if len(at):
            own.append((i, at, end, [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), end.tolist())]))
            size += len(text)
        if size >= AT_A_TIME:
            yield own
            own, size = [], 0
    if own:
        yield own


def _numbers(own: list) -> np.ndarray:
    """Two numbers for each chunk: 64 bits of its digest, and REST_BITS more."""
    return np.frombuffer(b"".join(d for *_, digests in own for d in digests), "<i8").reshape(-1, 2) & np.array([-1, (1 << REST_BITS) - 1])


def chunk_prints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The print of each chunk, and no more: what a first count of equal chunks has to send."""
    byte_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for own in _cut(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(_numbers(own)[:, 0]))], ["print"])
        release_memory()

    return docs.select(text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "print bigint")


def chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, start, length, print and rest (the digest) of each chunk; again: an equal chunk stands before it in the same text."""
    byte_batches(docs.sparkSession)
    source = _keyed(docs, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for own in _cut(batch):
                rows, starts, ends, _ = zip(*own)
                row = pa.array(np.repeat(rows, [len(at) for at in starts]))
                again = []
                for *_, digests in own:
                    seen: set = set()
                    again += [d in seen or seen.add(d) is not None for d in digests]
                at, numbers = np.concatenate(starts), np.asfortranarray(_numbers(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("text_hash").take(row), pa.array(at, pa.int32()), pa.array(np.concatenate(ends) - at, pa.int32()), pa.array(numbers[:, 0]), pa.array(numbers[:, 1]), pa.array(again, pa.bool_())],
                    ["doc_id", "text_hash", "start", "length", *DIGEST, "again"],
                )
        release_memory()

    return source.mapInArrow(run, f"doc_id {id_type}, text_hash bigint, start int, length int, print bigint, rest bigint, again boolean")


def repeated_chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and the sorted list of the chunks that it has in common with other texts, or twice: structs of start, length, first_id, stays (it is the first of them).
    Texts of which all such chunks stay are left out.

    All chunks are counted by their prints alone; whole digests, with the places of their chunks, are written and shuffled only of prints that occur twice."""
    spark = docs.sparkSession
    prints = chunk_prints(docs, text_col).groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print")
    prints = materialize(prints, "chunk-prints")
    release_shuffles(spark)  # that of all prints is the largest
    some = materialize(thin(chunks(docs, text_col), prints, ["print"]), "chunk-digests")
    # half of the hash tells texts of one doc_id apart here: two that agree in it both keep the chunk
    half = F.shiftright("text_hash", 32).cast("int")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", half.alias("half"))).alias("first")
    twice = some.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1").select(*DIGEST, F.col("first.doc_id").alias("first_id"), F.col("first.half").alias("first_hash"))
    met = salted_join(some, twice, DIGEST, salts=8)
    met = met.withColumn("stays", ~F.col("again") & F.col("doc_id").eqNullSafe(F.col("first_id")) & (half == F.col("first_hash")))
    lists = met.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "length", "first_id", "stays"))).alias("repeats"))
    return lists.filter(F.exists("repeats", lambda r: ~r["stays"]))


def _runs(text: bytes, repeats: list[dict], min_words: int) -> list[tuple[int, int, list]]:
    """(start, end, first ids) of what goes: runs of overlapping or adjoining repeats with at least min_words words, less the chunks in them that stay."""
    runs: list = []
    for r in repeats:
        a, b = r["start"], r["start"] + r["length"]
        if r["stays"]:
            continue
        if runs and runs[-1][1] >= a:
            runs[-1][1] = max(runs[-1][1], b)
            runs[-1][2].append(r["first_id"])
        else:
            runs.append([a, b, [r["first_id"]]])
    kept = [(r["start"], r["start"] + r["length"]) for r in repeats if r["stays"]]
    out, k = [], 0
    for a, b, firsts in runs:
        own = text[a:b]
        if max(len(own.split()), len(own.decode()) // WORD_CHARS) < min_words:
            continue
        while k < len(kept) and kept[k][1] <= a:  # starts and ends of chunks both rise
            k += 1
        for c, d in kept[k:]:
            if c >= b:
                break
            if a < c:
                out.append((a, c, firsts))
            a = max(a, d)
        if a < b:
            out.append((a, b, firsts))
    return out


def cut_repeats(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, found_col: str | None = None) -> DataFrame:
    """docs without the runs of repeated chunks; found_col, if given, gets a struct: spans (bytes of the text as it was) and repeat_of (doc_ids that keep them)."""
    with scratch_scope(docs.sparkSession):
        repeats = materialize(repeated_chunks(docs, text_col), "chunk-repeats", stays=True)
    release_shuffles(docs.sparkSession)
    named = repeats.select(F.col("doc_id").alias("repeat_id"), F.col("text_hash").alias("repeat_hash"), "repeats")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found_type = f"struct<spans:array<struct<start:int,end:int>>,repeat_of:array<{id_type}>>"
    # documents that surely lose nothing pass by; the others meet their repeats
    own = docs.select(whole_row(docs), docs["doc_id"], docs[text_col].alias("text"))
    apart, some = part_by_keys(own, named, "doc_id", "repeat_id")
    met = some.join(named, F.col("doc_id").eqNullSafe(F.col("repeat_id")) & (F.xxhash64(text_of()) == F.col("repeat_hash")), "left")

    def run(batches):
        for batch in batches:
            texts, spans, firsts = [], [], []
            for t, r in zip(batch.column("text"), batch.column("repeats")):
                t, r = t.as_py(), r.as_py()
                raw = (t or "").encode()
                runs = _runs(raw, r or [], min_words)
                if runs:
                    at = [0, *(x for a, b, _ in runs for x in (a, b)), len(raw)]
                    t = b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2])).decode()
                texts.append(t)
                spans.append([{"start": a, "end": b} for a, b, _ in runs] or None)
                firsts.append(sorted({i for *_, ids in runs for i in ids if i is not None}) if runs else None)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            ids = pa.list_(batch.schema.field("doc_id").type)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(spans, kind), pa.array(firsts, ids)], ["row", "new_text", "spans", "repeat_of"])
        release_memory()

    schema = T.StructType([T.StructField("row", own.schema["row"].dataType), *T.StructType.fromDDL(f"new_text string, spans array<struct<start:int,end:int>>, repeat_of array<{id_type}>")])
    cut = met.select("row", "doc_id", "text", "repeats").mapInArrow(run, schema)
    found = F.when(F.col("spans").isNotNull(), F.struct("spans", "repeat_of")).cast(found_type)
    cut = cut.select(*row_columns(docs, **{text_col: F.col("new_text")}), *([found.alias(found_col)] if found_col else []))
    return apart.select(*row_columns(docs), *([F.lit(None).cast(found_type).alias(found_col)] if found_col else [])).unionByName(cut)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), found_col="found")
    cut = F.aggregate(F.coalesce("found.spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", cut.alias("cut_bytes"), F.octet_length(text_of()).cast("long").alias("kept_bytes"), F.col("found.spans").alias("spans"), F.col("found.repeat_of").alias("repeat_of"), F.sha2(text_of(), 256).alias("kept_sha256"))
