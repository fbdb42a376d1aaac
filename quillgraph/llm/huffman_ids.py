"""Token ids in files of canonical, length-limited Huffman codes.

Texts are tokenized once and their ids written; the counts of all ids, taken in each task and summed, give code lengths by package-merge, and the lengths alone,
which the archive's codebook holds, give the codes. Documents are dealt to parts by ranges of doc_id and sorted, and each part is written as blocks.

The format, in a folder that any Parquet reader can open:
  codebook: id, bits. Codes of equal length are numbered by id, shorter ones first (canonical), most significant bit first.
  blocks: part, block, first (ids of the part before it), n_tokens, payload (the codes), checkpoints (bit offset of each CHECKPOINT-th id), crc32 (of the ids as
    little-endian unsigned 32-bit integers), documents (nth of the part, doc_id, n_tokens, begin: ids of the document before the piece, length).
A block needs no other to be decoded, and from its checkpoints on it is decoded in step by one table look-up an id. Blocks have BLOCK_TOKENS ids, the last
of a part fewer; a document goes on in the next block. The parts in order, and in each the blocks, hold all ids in ascending doc_id order.

The codebook and its decoding table are bounded by the vocabulary, a task's memory by a block and a document's ids. The window that gives a part's first position sees a row for
each part. The checksum of a document over several blocks is the exclusive or of its pieces' checksums, each carried on over the bytes behind it, so no piece meets another.

Defined results: a null or empty text has the end id alone; null doc_ids come first; rows with one doc_id stand in a row, in the order in which they were
read; a very long text is cut into blocks, whole; an empty table gives an archive without blocks and no rows; doc_ids may have any type that can be ordered; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_batches, materialize, read_table, release_memory, scratch_path, scratch_scope, slices, text_of
from .word_ids import word_ids

MAX_BITS = 20
BLOCK_TOKENS = 1 << 16
CHECKPOINT = 64
#: Ids of a part, at which parts outnumber the shuffle partitions.
PART_TOKENS = 1 << 25
AT_A_TIME = 1 << 21


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code: of all prefix codes of at most max_bits the one of the least total, by package-merge."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols have no code of {max_bits} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    row, own = coins, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, pairs])
        by_weight = np.argsort(both, kind="stable")
        row = both[by_weight]
        own.append(by_weight < n)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_coin in reversed(own):
        coins_taken = np.count_nonzero(is_coin[:take])
        bits[order[:coins_taken]] += 1
        take = 2 * (take - coins_taken)
    return bits


class Codebook:
    """The canonical code of ids and their bits; encodes and decodes arrays of ids."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        ids, bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.longest = int(bits[-1]) if len(bits) else 1
        if self.longest > 25 or len(ids) and ids.max() >= 1 << 27:
            raise ValueError("codes have up to 25 bits, ids up to 27")
        room = np.int64(1) << (self.longest - bits)
        top = int(ids.max()) + 1 if len(ids) else 0
        #: Codes with their first bit at the top of a word, and their bits.
        self.code, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.uint32)
        self.code[ids], self.bits[ids] = (np.cumsum(room) - room).astype(np.uint64) << np.uint64(64 - self.longest), bits
        #: For each value of the next `longest` bits the id that they begin with, and its bits in the lowest five.
        self.table = np.ones(1 << self.longest, np.uint32)
        self.table[: int(room.sum())] = np.repeat(ids << 5 | bits, room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes in a row, and the bit offset of each CHECKPOINT-th id."""
        bits = self.bits[ids]
        end = np.cumsum(bits, dtype=np.uint32)
        at = end - bits
        word = at >> np.uint32(5)
        # a code begins in each word of 32 bits and reaches into the next one at most
        first = np.flatnonzero(np.diff(word, prepend=np.uint32(0xFFFFFFFF)))
        both = np.bitwise_or.reduceat(self.code[ids] >> (at & np.uint32(31)), first)
        out = np.zeros(len(both) + 1, np.uint32)
        out[:-1] = both >> np.uint64(32)
        out[1:] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8], at[::CHECKPOINT]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """n ids from the first checkpoint on: a look-up for each checkpoint at a time."""
        raw = np.frombuffer(payload + bytes(CHECKPOINT * self.longest // 8 + 8), np.uint8).astype(np.uint32)
        four = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        at = checkpoints.astype(np.uint32)
        rest = np.uint32(32 - self.longest)
        found = np.zeros((CHECKPOINT, len(at)), np.uint32)
        for k in range(CHECKPOINT):
            own = found[k] = self.table[(four[at >> np.uint32(3)] << (at & np.uint32(7))) >> rest]
            at += own & np.uint32(31)
        return (found.T >> np.uint32(5)).reshape(-1)[:n]


@lru_cache(1)
def _zeros() -> list[list[int]]:
    """What 1, 2, 4, ... zero bytes make of each bit of a CRC-32."""
    one = [0xEDB88320, *(1 << k for k in range(31))]  # a zero bit; the constant is the polynomial of CRC-32
    times = lambda m, v: [_times(m, x) for x in v]
    for _ in range(3):
        one = times(one, one)
    out = [one]
    while len(out) < 48:
        out.append(times(out[-1], out[-1]))
    return out


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
        if not vector:
            break
    return out


def carried(crc: int, n_bytes: int) -> int:
    """A checksum's part in that of the same bytes with n_bytes more behind them: crc32(a + b) = carried(crc32(a), len(b)) ^ crc32(b)."""
    for k, matrix in enumerate(_zeros()):
        if n_bytes >> k & 1:
            crc = _times(matrix, crc)
    return crc


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nth (the order of reading), n_tokens, ids (binary, little-endian integers of id_width() bytes) of each row, with the end id."""
    byte_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    kind = f"<u{id_width(tokenizer_path, end_id)}"

    def run(batches):
        encode = word_ids(tokenizer_path).encode
        end = np.array([end_id], np.uint32)
        nth = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b in slices(pa.compute.binary_length(batch.column("text")).to_pylist(), AT_A_TIME):
                part = batch.slice(a, b - a)
                ids = [np.concatenate([x, end]) for x in encode(part.column("text").to_pylist())]
                n = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(range(nth, nth + len(ids)), pa.int64()), n, pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], ["doc_id", "nth", "n_tokens", "ids"])
                nth += len(ids)
        release_memory()

    return source.mapInArrow(run, f"doc_id {id_type}, nth bigint, n_tokens bigint, ids binary")


@lru_cache(8)
def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes of an id while ids are on their way."""
    return 2 if max(word_ids(tokenizer_path).tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def id_counts(tokens: DataFrame, width: int) -> DataFrame:
    """id, n over all rows: a task hands on one row for each id that it met."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.concatenate([np.frombuffer(raw.as_buffer(), f"<u{width}") for raw in batch.column("ids")]))
            if len(own) > len(seen):
                own[: len(seen)] += seen
                seen = own
            else:
                seen[: len(own)] += own
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(tokens: DataFrame, codebook: Codebook, width: int, block_tokens: int) -> DataFrame:
    """The rows of the format's blocks, from rows that are sorted within their partitions."""
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    piece = f"struct<nth:bigint,doc_id:{id_type},n_tokens:bigint,begin:bigint,length:int>"

    def run(batches):
        part, block, first, nth, held, pieces, size, types = TaskContext.get().partitionId(), 0, 0, 0, [], [], 0, None

        def out():
            nonlocal block, first, held, pieces, size
            ids = np.concatenate(held)
            payload, checkpoints = codebook.encode(ids)
            kind = pa.struct([("nth", pa.int64()), ("doc_id", types), ("n_tokens", pa.int64()), ("begin", pa.int64()), ("length", pa.int32())])
            cols = list(zip(*pieces))
            docs = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pa.StructArray.from_arrays([pa.array(c, kind.field(k).type) for k, c in enumerate(cols)], fields=list(kind)))
            row = {"part": ([part], pa.int32()), "block": ([block], pa.int32()), "first": ([first], pa.int64()), "n_tokens": ([size], pa.int32()), "payload": ([payload], pa.binary()), "checkpoints": ([checkpoints], pa.list_(pa.int32())), "crc32": ([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64())}
            batch = pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in row.values()), docs], [*row, "documents"])
            block, first, held, pieces, size = block + 1, first + size, [], [], 0
            return batch

        for batch in batches:
            types = batch.schema.field("doc_id").type
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                begin = 0
                while begin < len(ids):
                    own = ids[begin : begin + block_tokens - size]
                    held.append(own)
                    pieces.append((nth, doc, len(ids), begin, len(own)))
                    begin, size = begin + len(own), size + len(own)
                    if size == block_tokens:
                        yield out()
                nth += 1
            held = [np.concatenate(held)] if held else held  # lets the batch go
        if size:
            yield out()
        release_memory()

    return tokens.select("doc_id", "ids").mapInArrow(run, f"part int, block int, first bigint, n_tokens int, payload binary, checkpoints array<int>, crc32 bigint, documents array<{piece}>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes path/codebook and path/blocks. The driver sees the counts of ids, a row for each entry of the vocabulary at most."""
    spark = docs.sparkSession
    width = id_width(tokenizer_path, end_id)
    with scratch_scope(spark):
        tokens = materialize(token_rows(docs, tokenizer_path, end_id, id_col, text_col), "token-ids")
        counts = id_counts(tokens, width).toPandas().sort_values("id")
        ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
        bits = code_lengths(n, max(max_bits, math.ceil(math.log2(len(n) or 1))))
        spark.createDataFrame(list(zip(ids.tolist(), bits.tolist())), "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codebook")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(n.sum()) / PART_TOKENS))
        by = [F.col("doc_id").asc_nulls_first(), F.col("nth").asc()]
        ordered = tokens.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        # the codes are as short as they can be
        _blocks(ordered, Codebook(ids, bits), width, block_tokens).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    """Bounded by the vocabulary."""
    rows = spark.read.parquet(f"{path}/codebook").toPandas()
    return Codebook(rows["id"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64))


def _first_of_parts(blocks: DataFrame) -> DataFrame:
    """part, before: ids of all parts before it. A row for each part."""
    size = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return size.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"))


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a block: part, nth, doc_id, n_tokens (the document's), begin, length, at (its first id's place in the part), crc32 (the piece's
    part in the document's checksum) and, if wanted, ids (binary, little-endian unsigned 32-bit integers). A block whose ids have another checksum than it names raises an error."""
    byte_batches(spark)
    codebook = read_codebook(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["documents"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                n, first = row["n_tokens"].as_py(), row["first"].as_py()
                checkpoints = row["checkpoints"].values.to_numpy()
                ids = codebook.decode(row["payload"].as_py(), checkpoints, n).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["crc32"].as_py():
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                docs = row["documents"].values
                nth, total, begin, length = (docs.field(c).to_numpy() for c in ("nth", "n_tokens", "begin", "length"))
                end = np.cumsum(length)
                own = [ids[b - m : b].tobytes() for b, m in zip(end.tolist(), length.tolist())]
                behind = (4 * (total - begin - length)).tolist()
                crc = [carried(zlib.crc32(x), more) if more else zlib.crc32(x) for x, more in zip(own, behind)]
                cols = [pa.repeat(row["part"], len(own)), docs.field("nth"), docs.field("doc_id"), docs.field("n_tokens"), docs.field("begin"), docs.field("length"), pa.array(first + end - length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(own, pa.binary())] if with_ids else [])], names)
        release_memory()

    schema = f"part int, nth bigint, doc_id {id_type}, n_tokens bigint, begin bigint, length int, at bigint, crc32 bigint" + (", ids binary" if with_ids else "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return blocks.select("part", "block", "first", "n_tokens", "payload", "checkpoints", "crc32", "documents").mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document of an archive. A document that lacks a piece raises an error."""
    whole = read_pieces(spark, path).groupBy("part", "nth").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sum("length").alias("found"), F.min(F.col("at") - F.col("begin")).alias("at"), F.bit_xor("crc32").alias("ids_crc32")
    )
    whole = whole.withColumn("n_tokens", F.when(F.col("found") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a piece of a document is missing")).cast("long")))
    firsts = _first_of_parts(spark.read.parquet(f"{path}/blocks"))
    return whole.join(firsts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """start, ids of the runs that make up the given range of an archive's ids: only blocks that meet it are decoded, and of these only from the checkpoint before it on."""
    codebook = read_codebook(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    placed = blocks.join(_first_of_parts(blocks), "part").withColumn("place", F.col("before") + F.col("first"))
    met = placed.filter((F.col("place") < start + length) & (F.col("place") + F.col("n_tokens") > start)).select("place", "n_tokens", "payload", "checkpoints")

    def run(batches):
        for batch in batches:
            for place, n, payload, checkpoints in zip(*(batch.column(c).to_pylist() for c in ("place", "n_tokens", "payload", "checkpoints"))):
                a, b = max(start, place) - place, min(start + length, place + n) - place
                from_, to = a // CHECKPOINT, -(-b // CHECKPOINT)
                ids = codebook.decode(payload, np.array(checkpoints[from_:to]), b - from_ * CHECKPOINT)[a - from_ * CHECKPOINT :]
                yield pa.RecordBatch.from_arrays([pa.array([place + a], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int32()))], ["start", "ids"])

    return met.mapInArrow(run, "start bigint, ids array<int>")


def op11_huffman_ids(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "huffman")
    write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)
