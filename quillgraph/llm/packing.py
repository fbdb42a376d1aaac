"""Hierarchical multi-length packing.

Documents are routed to tiers of context sizes (powers of two up to the window): whole windows are cut from
long documents, the rest goes to the shortest tier that holds it. Tiers are packed from the longest down; the
gap of a long window is filled with the largest pieces of shorter tiers that fit, the last one cut to close it.
Windows of a tier are dealt to step groups of equal token counts over all tasks; only the last group of a tier may have fewer.

Each task packs its own rows in bounded buffers, so no text or token is shuffled and no key can be skewed. The end of a task
is cut into windows of falling powers of two: no padding at all, at the price of at most log2(window) short windows a task. Tasks number their
windows; the counts of a task and tier, one row each, give the numbers over all tasks.

Defined results: a null or empty text is one piece with the end id; repeated rows are documents of their own; a very long text is cut into
windows, whole, by one task; of remainders of equal length the first read goes first; an empty table gives no rows; other columns are not read.
sequence_id = partition << 33 | number in it.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_batches, materialize, read_table, release_memory, slices, text_of
from .word_ids import word_ids

WINDOW = 4096
SMALLEST_TIER = 512
#: Windows of 4096 tokens in a step group; shorter tiers have as many tokens in more windows.
STEP_WINDOWS = 8
#: Tokens that a task gathers before it packs; bytes of text that are tokenized at a time.
BUFFER_TOKENS = 1 << 20
AT_A_TIME = 1 << 20

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "nth")


class Packer:
    """Packs (row, doc_id, ids) pieces; rows of COLUMNS gather in self.out."""

    def __init__(self, first_id: int, window: int = WINDOW, smallest: int = SMALLEST_TIER):
        self.window, self.tiers = window, [t for t in (1 << k for k in range(40)) if smallest <= t <= window]
        self.first_id, self.n = first_id, 0
        self.out: list[tuple] = []
        self.in_tier: dict[int, int] = {}

    def sequence(self, context: int, parts: list[tuple]) -> None:
        """parts: (doc_id, ids, start, end, doc_tokens), from offset 0 on."""
        at, name = 0, self.first_id | self.n
        self.n += 1
        nth = self.in_tier.get(context, 0)
        self.in_tier[context] = nth + 1
        for doc, ids, a, b, total in parts:
            self.out.append((doc, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), total, name, at, context, nth))
            at += b - a

    def pack(self, docs: list[tuple], last: bool) -> list[tuple]:
        """docs: (doc_id, ids, start) with the ids from start on still to pack. Returns what must wait for more unless it is the last."""
        by_tier: dict[int, list] = {t: [] for t in self.tiers}
        for k, (doc, ids, a) in enumerate(docs):
            while len(ids) - a >= self.window:
                self.sequence(self.window, [(doc, ids, a, a + self.window, len(ids))])
                a += self.window
            if (rest := len(ids) - a) > 0:
                heapq.heappush(by_tier[next(t for t in self.tiers if t >= rest)], (-rest, k, doc, ids, a))
        wait: list[tuple] = []
        for i in range(len(self.tiers) - 1, -1, -1):
            context, items = self.tiers[i], by_tier[self.tiers[i]]
            shorter = self.tiers[i - 1 :: -1] if i else []
            while items:
                _, k, doc, ids, a = heapq.heappop(items)
                parts, gap = [(doc, ids, a, len(ids), len(ids))], context - (len(ids) - a)
                while gap:
                    fit = next((t for t in shorter if by_tier[t] and -by_tier[t][0][0] <= gap), None)
                    source = by_tier[fit] if fit else items if i == 0 and items else next((by_tier[t] for t in reversed(shorter) if by_tier[t]), None)
                    if not source:
                        break
                    _, k, doc, ids, a = heapq.heappop(source)
                    b = min(len(ids), a + gap)
                    parts.append((doc, ids, a, b, len(ids)))
                    gap -= b - a
                    if b < len(ids):
                        heapq.heappush(by_tier[next(t for t in self.tiers if t >= len(ids) - b)], (b - len(ids), k, doc, ids, b))
                if gap:
                    wait += [(doc, ids, a, b, total) for doc, ids, a, b, total in parts]
                else:
                    self.sequence(context, parts)
        return self.close(wait, last)

    def close(self, parts: list[tuple], last: bool) -> list[tuple]:
        """Pieces that found no filling, end to end: whole windows, and at the end falling powers of two. While more is to come, the rest waits: its cut documents too."""
        if not last and all(b == total for _, _, _, b, total in parts):
            return [(doc, ids, a) for doc, ids, a, _, _ in parts]
        total = sum(b - a for _, _, a, b, _ in parts)
        queue = [*reversed(parts)]
        size = self.window
        while total:
            while size > total:
                size >>= 1
            total -= size
            own, gap = [], size
            while gap:
                doc, ids, a, b, n = queue.pop()
                cut = min(b, a + gap)
                own.append((doc, ids, a, cut, n))
                gap -= cut - a
                if cut < b:
                    queue.append((doc, ids, cut, b, n))
            self.sequence(size, own)
        return []

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, smallest: int = SMALLEST_TIER, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """A row for each piece, with COLUMNS: context is the length of its sequence, nth the number of that sequence among its task's of this length."""
    byte_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, context bigint, nth bigint"

    def run(batches):
        encode = word_ids(tokenizer_path).encode
        packer = Packer(TaskContext.get().partitionId() << 33, window, smallest)
        held, size, types = [], 0, None
        end = np.array([end_id], np.uint32)

        def rows():
            cols = list(zip(*packer.drain())) or [()] * len(COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, types if k == 0 else pa.int64()) for k, c in enumerate(cols)], list(COLUMNS))

        for batch in batches:
            types = batch.schema.field("doc_id").type
            for a, b in slices(pa.compute.binary_length(batch.column("text")).to_pylist(), AT_A_TIME):
                part = batch.slice(a, b - a)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    held.append((doc, np.concatenate([ids, end]), 0))
                    size += len(ids) + 1
                if size >= buffer_tokens:
                    held = packer.pack(held, False)
                    size = sum(len(ids) - a for _, ids, a in held)
                    yield rows()
        if held:
            packer.pack(held, True)
        if packer.out:
            yield rows()
        release_memory()

    return source.mapInArrow(run, schema)


def step_groups(pieces: DataFrame, window: int = WINDOW, step_windows: int = STEP_WINDOWS) -> DataFrame:
    """pieces of pack_tokens() with step_group in place of nth: sequences of a context, numbered over all tasks, are dealt to groups of step_windows * window tokens.

    The window function sees a row for each task and context only, and so does the smaller side of the join, whose size Spark checks before it broadcasts it.
    """
    pieces = materialize(pieces.withColumn("task", F.shiftright("sequence_id", 33)), "packed-pieces")
    counts = pieces.groupBy("context", "task").agg((F.max("nth") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("context").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("context", "task", before.alias("before"))
    per_group = F.floor(F.lit(step_windows * window) / F.col("context"))
    return pieces.join(firsts, ["context", "task"]).withColumn("step_group", F.floor((F.col("before") + F.col("nth")) / per_group).cast("long")).drop("task", "before", "nth")


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return step_groups(pack_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json")))
