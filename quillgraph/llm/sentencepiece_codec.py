"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Spaces become the marker U+2581 with one more in front; the best path of pieces (the largest sum of scores; of equal paths the one
whose last pieces begin earliest) is found over a trie of the pieces' bytes, held as a double array. A character
that no piece covers costs the least score less 10 and is written as byte pieces. Decoding joins the
pieces, turns markers into spaces and drops the first.

Where no piece holds a character before a marker, a text falls into independent units (markers and what follows them); each
distinct unit is solved once, all of a batch in step, and kept in a table of bounded size. A model for which that does not hold
is solved text by text.

The scores are those of the model file, whichever algorithm trained it: on a file of BPE kind this is the unigram path over its
scores (tests hold it against plain dynamic programming), not the path of its merges.

Defined results: a null or empty text has no piece; repeated rows are encoded one by one; a very long text is encoded whole, by itself; an empty table gives no rows; there is no shuffle; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, read_table, slices, text_of

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
MAX_UNITS = 300_000
#: Bytes of text that are encoded at a time.
AT_A_TIME = 1 << 19


class DoubleArray:
    """Trie over byte strings: from state s, byte c leads to base[s] + c if check there is s; value >= 0 marks a word's end."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, v in words.items():
            s = 0
            for c in word:
                nxt = children[s].get(c)
                if nxt is None:
                    nxt = children[s][c] = len(children)
                    children.append({})
                    value.append(-1)
                s = nxt
            value[s] = v
        size = 2 * len(children) + 1024
        used = np.zeros(size, bool)
        used[0] = True
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        place = {0: 0}
        free = top = 1
        queue = [0]
        for s in queue:
            own = place[s]
            self.value[own] = value[s]
            if not (kids := children[s]):
                continue
            codes = np.fromiter(kids, np.int64, len(kids))
            if top + 512 >= len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
                self.base, self.check, self.value = (np.concatenate([x, np.full(len(x), f, np.int64)]) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
            if len(kids) == 1:  # these fill the holes
                free += int(np.argmin(used[free:]))
                b = max(1, free - int(codes[0]))
                b += int(np.argmin(used[b + codes[0] :]))
            else:
                bases = np.arange(max(1, top - 768), top + 2)
                b = int(bases[np.argmin(used[bases[:, None] + codes].any(axis=1))])
            top = max(top, b + int(codes.max()))
            self.base[own] = b
            used[b + codes] = True
            self.check[b + codes] = own
            for c, k in kids.items():
                place[k] = b + c
                queue.append(k)


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float64)
        byte = {i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if i not in byte and not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i)]
        self.byte_id = np.full(256, sp.unk_id(), np.int64)
        for i in byte:
            self.byte_id[int(pieces[i][3:5], 16)] = i
        self.has_bytes = bool(byte)
        self.unknown = float(min(self.score[i] for i in plain)) - UNKNOWN_PENALTY
        self.trie = DoubleArray({pieces[i].encode(): i for i in plain})
        self.longest = max(len(pieces[i].encode()) for i in plain)
        spell = [bytes([int(p[3:5], 16)]) if i in byte else p.replace(MARKER, " ").encode() if not sp.is_control(i) else b"" for i, p in enumerate(pieces)]
        self.spell = np.frombuffer(b"".join(spell), np.uint8)
        self.spell_len = np.array([len(x) for x in spell], np.int64)
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(byte)] = True
        inner = any(MARKER in pieces[i].lstrip(MARKER) for i in plain)
        alone = "".join(c for c in "\n\t\r" if not any(c in pieces[i] for i in plain))  # in no piece: parts units too
        self.units = None if inner else re.compile(f" *[^ {alone}]+|[{alone}]| +" if alone else " *[^ ]+| +")
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.start, self.length, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best paths of all units in a row, and how many each has."""
        raw = [u.replace(" ", MARKER).encode() for u in units]
        text = np.frombuffer(b"\0".join(raw) + b"\0" * (self.longest + 1), np.uint8)  # between units a zero, on which the trie ends
        size = np.array([len(r) for r in raw], np.int64)
        first = np.cumsum(size + 1) - (size + 1)
        gap = np.zeros(len(text), bool)
        gap[first + size] = True
        gap[int(first[-1] + size[-1]) :] = True
        head = (text & 0xC0) != 0x80
        head[gap] = False
        begin = np.flatnonzero(head)
        width = np.select([text[begin] < 0x80, text[begin] < 0xE0, text[begin] < 0xF0], [1, 2, 3], 4)
        state, at = np.zeros(len(begin), np.int64), begin
        starts, lengths, ids = [], [], []
        own = np.arange(len(begin))
        single = np.zeros(len(begin), bool)
        t = self.trie
        for k in range(self.longest):
            ok = ~gap[at + k]
            nxt = t.base[state] + text[at + k]
            ok &= t.check[nxt] == state
            at, state, own = at[ok], nxt[ok], own[ok]
            if not len(at):
                break
            word = t.value[state] >= 0
            starts.append(at[word])
            lengths.append(np.full(int(word.sum()), k + 1))
            ids.append(t.value[state[word]])
            single[own[word & (width[own] == k + 1)]] = True
        starts.append(begin[~single])
        lengths.append(width[~single])
        ids.append(np.full(int((~single).sum()), -1))
        start, length, piece = (np.concatenate(x).astype(np.int64) for x in (starts, lengths, ids))
        score = np.where(piece >= 0, self.score[piece], self.unknown)
        end = start + length
        unit = np.searchsorted(first, start, side="right") - 1
        order = np.lexsort((start, end, end - first[unit]))  # by distance from the unit's start: units go in step
        start, end, piece, score, dist = start[order], end[order], piece[order], score[order], (end - first[unit])[order]
        best = np.full(len(text) + 1, -np.inf)
        best[first] = 0
        chosen = np.full(len(text) + 1, -1, np.int64)
        cuts = np.flatnonzero(np.diff(dist, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(dist)]):
            e, cand = end[a:b], best[start[a:b]] + score[a:b]
            if b - a == 1:
                best[e[0]], chosen[e[0]] = cand[0], a
                continue
            new = np.flatnonzero(np.diff(e, prepend=-1))
            top = np.maximum.reduceat(cand, new)
            group = np.repeat(np.arange(len(new)), np.diff(np.append(new, b - a)))
            is_top = np.flatnonzero(cand == top[group])
            lead = is_top[np.flatnonzero(np.diff(group[is_top], prepend=-1))]
            best[e[lead]], chosen[e[lead]] = top, a + lead
        on_path = np.zeros(len(text) + 1, bool)
        now = (first + size)[size > 0]
        floor = first[size > 0]
        while len(now):
            on_path[now] = True
            now = start[chosen[now]]
            more = now > floor
            now, floor = now[more], floor[more]
        ends = np.flatnonzero(on_path)
        edge = chosen[ends]
        n_ids = np.where(piece[edge] >= 0, 1, (end - start)[edge] if self.has_bytes else 1)
        out = np.repeat(piece[edge], n_ids)
        if (lost := np.repeat(piece[edge] < 0, n_ids)).any():
            within = np.arange(len(out)) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids)
            out[lost] = self.byte_id[text[np.repeat(start[edge], n_ids)[lost] + within[lost]]]
        counts = np.bincount(np.searchsorted(first, ends - 1, side="right") - 1, weights=n_ids, minlength=len(units)).astype(np.int64)
        return out, counts

    def learn(self, units: list[str]) -> None:
        for k in range(0, len(units), 20_000):
            part = units[k : k + 20_000]
            ids, counts = self.solve(part)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while len(self.at) + len(part) > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            n = len(self.at)
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[n : n + len(part)] = self.used + np.cumsum(counts) - counts
            self.length[n : n + len(part)] = counts
            self.used += len(ids)
            self.at.update(zip(part, range(n, n + len(part))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > MAX_UNITS:
            self.clear()
        units, counts = [], []
        for t in texts:
            own = (self.units.findall(" " + t) if self.units else [" " + t]) if t else []
            units += own
            counts.append(len(own))
        get = self.at.get
        index = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        if len(missing := np.flatnonzero(index < 0)):
            self.learn(list(dict.fromkeys(units[i] for i in missing.tolist())))
            index[missing] = [get(units[i]) for i in missing.tolist()]
        length = self.length[index]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[index] - (ends - length), length) + np.arange(total)]
        cut = np.concatenate([[0], ends])[np.cumsum(counts)].astype(np.int64)
        return np.split(ids, cut[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        n = self.spell_len[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        raw = self.spell[np.repeat(self.spell_at[ids] - (ends - n), n) + np.arange(total)].tobytes()
        return raw.decode(errors="replace").removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each document."""
    return _encoded(docs, model_path, id_col, text_col, "ids array<int>", lambda c, texts, ids: [pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))])


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each list of ids; a null list is the empty text."""
    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        decode = codec(model_path).decode
        for batch in batches:
            texts = [decode(np.array(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def piece_summary(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and whether the ids decode to the text."""

    def columns(c: Codec, texts, ids):
        return [
            pa.array([len(x) for x in ids], pa.int64()), pa.array([int(c.is_byte[x].sum()) for x in ids], pa.int64()),
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([c.decode(x) == t for x, t in zip(ids, texts)]),
        ]

    return _encoded(docs, model_path, id_col, text_col, "n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean", columns)


def _encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    byte_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        c = codec(model_path)
        for whole in batches:
            for a, b in slices(pa.compute.binary_length(whole.column("text")).to_pylist(), AT_A_TIME):
                batch = whole.slice(a, b - a)
                texts = batch.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns(c, texts, c.encode(texts))], names)

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {schema}")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return piece_summary(read_table(spark, sf_dir, "documents"), model_path or public_tokenizers.path("piece_bpe_32k.model"))
