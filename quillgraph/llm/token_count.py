"""Token counts by finite-state transducers.

The pre-tokenizer of the byte-level BPE files is compiled to a deterministic transducer over character classes:
a transition says whether a pretoken begins at the current or (after a character of look-ahead) at the previous
character. A block of text is cut into chunks; all chunks are run in step from every state at once, which gives
each chunk's state map; the maps compose through a parallel prefix scan, which gives each chunk's entry state;
a last run from those states reads off the boundaries. A second transducer, compiled from the merges, runs over each
pretoken's bytes: its transitions carry the tokens that they emit (merge_transducer.py). What a whole pretoken emits is
kept for the next time it comes.

Classes of characters outside ASCII are asked of the library's own pre-tokenizer, once for each character; counts are not
asked of it. Memory is bounded: blocks of BLOCK characters, a table of MAX_TRANSITIONS pretokens, MAX_STATES of the merges.

Defined results: a null or empty text has 0 tokens; the string of an added token counts as that token, as the
library does by default; repeated rows are counted one by one; a very long text is read whole, block by block; an empty table gives no rows; there is no shuffle, and other columns are not read.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, read_table, slices, text_of
from .merge_transducer import MergeTransducer

BLOCK = 1 << 20
CHUNK = 128
MAX_TRANSITIONS = 400_000

#: Classes of characters: other letters, s/t/m/d, r/v, l, e (these end contractions), digits, the space, other white space, the apostrophe, the rest; END parts texts.
LETTER, STMD, RV, EL, EE, DIGIT, SPACE, BLANK, QUOTE, OTHER, END = range(11)
UNKNOWN = 255
#: States: between pretokens, in letters, in digits, in others, after a first apostrophe, after 'r or 'v, after 'l, after one space, after more white space that ends in a space, the same with other white space.
START, IN_L, IN_N, IN_O, APOS, APOS_RV, APOS_L, ONE_SP, RUN_SP, ONE_BL, RUN_BL = range(11)
HERE, BEFORE = 16, 32


def compile_transducer() -> np.ndarray:
    """table[state, class] = next state | HERE (a pretoken begins at this character) | BEFORE (one begins at the character before)."""
    letters = {LETTER, STMD, RV, EL, EE}
    first = {**{c: IN_L for c in letters}, DIGIT: IN_N, SPACE: ONE_SP, BLANK: ONE_BL, QUOTE: APOS, OTHER: IN_O, END: START}
    table = np.zeros((11, 11), np.uint8)
    joined = {**{c: IN_L for c in letters}, DIGIT: IN_N, QUOTE: IN_O, OTHER: IN_O}  # what a space before it belongs to
    for c in range(11):
        new = first[c] | HERE
        in_letters = IN_L if c in letters else new
        table[START, c] = new
        table[IN_L, c] = in_letters
        table[IN_N, c] = IN_N if c == DIGIT else new
        table[IN_O, c] = IN_O if c in (OTHER, QUOTE) else new
        table[APOS, c] = {STMD: START, RV: APOS_RV, EL: APOS_L, OTHER: IN_O, QUOTE: IN_O}.get(c, new)
        table[APOS_RV, c] = START if c == EE else in_letters | BEFORE
        table[APOS_L, c] = START if c == EL else in_letters | BEFORE
        blank = {SPACE: RUN_SP, BLANK: RUN_BL}.get(c)
        for state, more in ((ONE_SP, 0), (RUN_SP, BEFORE)):
            table[state, c] = blank if blank is not None else new if c == END else joined[c] | more
        for state, more in ((ONE_BL, 0), (RUN_BL, BEFORE)):
            table[state, c] = blank if blank is not None else new if c == END else new | more
    return table


class Counter:
    """Token counts of one tokenizer file; one for each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.split = self.tok.pre_tokenizer.pre_tokenize_str
        self.added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.table = compile_transducer()
        self.merges = MergeTransducer(path)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.learn(np.arange(128, dtype=np.uint32))
        self.emits: dict[str, int] = {}

    def learn(self, codes: np.ndarray) -> None:
        for code in codes.tolist():
            c = chr(code)
            if code < 128 and c in "stmd":
                kind = STMD
            elif code < 128 and c in "rv":
                kind = RV
            elif code < 128 and c in "le":
                kind = EL if c == "l" else EE
            elif c in " '":
                kind = SPACE if c == " " else QUOTE
            elif 0xD800 <= code < 0xE000:
                kind = OTHER
            else:
                kind = next((k for probe, k in (("a", LETTER), ("1", DIGIT), ("!", OTHER)) if len(self.split(probe + c)) == 1), BLANK)
            self.classes[code] = kind

    def boundaries(self, classes: np.ndarray) -> np.ndarray:
        """Where pretokens begin, by state maps of chunks and a prefix scan. The last class must be END."""
        n = len(classes)
        k = -(-n // CHUNK)
        cls = np.full(k * CHUNK, END, np.intp)
        cls[:n] = classes
        cls = cls.reshape(k, CHUNK).T.copy()
        states = (self.table & 15).astype(np.intp).ravel()
        maps = np.tile(np.arange(11, dtype=np.intp), (k, 1))
        for j in range(CHUNK):
            maps = states[maps * 11 + cls[j][:, None]]
        step = 1
        while step < k:  # after this, maps[i] takes the state at the block's start to that after chunk i
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
            step *= 2
        state = np.concatenate([[START], maps[:-1, START]])
        flat = self.table.astype(np.intp).ravel()
        out = np.empty((CHUNK, k), np.uint8)
        for j in range(CHUNK):
            moved = flat[state * 11 + cls[j]]
            out[j] = moved
            state = moved & 15
        out = out.T.ravel()[:n]
        begins = (out & HERE) > 0
        begins[:-1] |= (out[1:] & BEFORE) > 0
        return np.flatnonzero(begins)

    def emitted(self, words: list[str]) -> np.ndarray:
        """What each pretoken emits; those not kept run through the merges' transducer."""
        if len(self.emits) > MAX_TRANSITIONS:
            self.emits = {}
        get = self.emits.get
        out = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            for i in missing.tolist():
                if (word := words[i]) not in self.emits:
                    self.emits[word] = self.merges.count(word)
            out[missing] = [get(words[i]) for i in missing.tolist()]
        return out

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The text without added tokens, and how many of them there are."""
        parts, n = [text], 0
        for token in self.added:
            if token in text:
                cut = [p.split(token) for p in parts]
                n += sum(len(c) - 1 for c in cut)
                parts = [p for c in cut for p in c]
        return parts, n

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        block, owner, size = [], [], 0
        for i, text in enumerate(texts):
            parts, special = self.pieces(text)
            out[i] += special
            for part in parts:
                for part in self.cut(part, i, out):
                    block.append(part)
                    owner.append(i)
                    size += len(part) + 1
                    if size >= BLOCK:
                        self.count_block(block, owner, out)
                        block, owner, size = [], [], 0
        if block:
            self.count_block(block, owner, out)
        return out

    def cut(self, text: str, i: int, out: np.ndarray):
        """A text longer than a block is read block by block; each block stops at the last pretoken that it shows whole."""
        while len(text) > 2 * BLOCK:
            head = text[:BLOCK]
            at = self.begins([head])[1]
            last = next((int(b) for b in at[::-1] if BLOCK - b > 4), 0)
            # white space before a boundary depends on what follows it: step back to a boundary after a letter, digit or sign
            kind = self.classes[np.frombuffer(head.encode("utf-32-le", "surrogatepass"), np.uint32)]
            good = [b for b in at[(at > 0) & (at < BLOCK - 4)][-1000:].tolist() if kind[b] in (SPACE, BLANK) and kind[b - 1] not in (SPACE, BLANK)]
            last = good[-1] if good else 0
            if not last:  # a pretoken of a whole block: no cut is known to be safe
                break
            yield head[:last]
            text = text[last:]
        yield text

    def begins(self, block: list[str]) -> tuple[str, np.ndarray]:
        joined = "\n".join(block) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[codes]
        if (unknown := classes == UNKNOWN).any():
            self.learn(np.unique(codes[unknown]))
            classes = self.classes[codes]
        ends = np.cumsum([len(x) + 1 for x in block]) - 1
        classes = classes.copy()
        classes[ends] = END
        return joined, self.boundaries(classes)

    def count_block(self, block: list[str], owner: list[int], out: np.ndarray) -> None:
        joined, at = self.begins(block)
        ends = np.append(at[1:], len(joined))
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        stop = np.cumsum(lengths + 1) - 1
        which = np.searchsorted(stop, at)
        inside = at != stop[which]  # an END begins a pretoken of its own, which isn't one
        words = [joined[a:b] for a, b in zip(at[inside].tolist(), ends[inside].tolist())]
        np.add.at(out, np.asarray(owner)[which[inside]], self.emitted(words))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: its id, n_bytes and n_tokens under the byte-level BPE file."""
    byte_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        count = counter(tokenizer_path).count
        for whole in batches:
            for a, b in slices(pa.compute.binary_length(whole.column("text")).to_pylist(), BLOCK):
                batch = whole.slice(a, b - a)
                text = batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.compute.binary_length(text).cast(pa.int64()), pa.array(count(text.to_pylist()))], ["doc_id", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None, limit: int = 512) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
