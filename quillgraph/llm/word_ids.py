"""Token ids of the word-end BPE file, word by word: its pattern never crosses white space, so the ids of a text
are those of its white-space-parted words in a row. Words are encoded once and kept in a table of bounded size, from which rare ones go first;
texts on which lower case or white space of Python and of the library could differ go to the library whole."""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_WORDS = 300_000
#: A character that makes a word, and a token, of its own; texts that hold it go to the library whole. Words of a run.
MARK = "\x01"
RUN = 256
#: Letters from U+0130 on may change length in lower case or compose; U+001C to U+001F, U+0085 and U+00A0 part words in one of the two only; "<|" may begin an added token.
_PLAIN = re.compile("[^\x01\x1c-\x1f\x85\xa0İ-\U0010ffff]*")
#: Words whose characters stay as they are under NFC and in lower case, without an apostrophe; and the parts that the file's pattern makes of them.
_SIMPLE = re.compile("[a-zß-öø-ÿ0-9!-&(-/:-@\\[-`{-~]+")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
WORD_END = "</w>"


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        (self.mark,) = self.tok.encode(MARK, add_special_tokens=False).ids
        # the same model, for parts of words that need neither the file's normalizers nor its pattern
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 18, np.uint32)
        self.start = np.zeros(MAX_WORDS // 4, np.int64)
        self.length = np.zeros(MAX_WORDS // 4, np.int32)
        self.uses = np.zeros(MAX_WORDS // 4, np.int64)
        self.used = 0

    def age(self) -> None:
        """The words of most use stay, half of the table at most, and their uses count half from now on."""
        n, least = len(self.at), 2
        while np.count_nonzero(self.uses[:n] >= least) > MAX_WORDS // 2:
            least *= 2
        keep = self.uses[:n] >= least
        uses, counts = self.uses[:n][keep] // 2, self.length[:n][keep].astype(np.int64)
        ids = self.gather(np.flatnonzero(keep))[0]
        words = [w for w, stays in zip(self.at, keep.tolist()) if stays]
        self.clear()
        self.put(words, ids, counts)
        self.uses[: len(words)] = uses

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places in a row, and where each word's end."""
        lengths = self.length[index].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[index] - (ends - lengths), lengths) + np.arange(total)], ends

    def put(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.at)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.uses))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.length[n : n + len(words)] = counts
        self.used += len(ids)
        self.at.update(zip(words, range(n, n + len(words))))

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words go to the library in runs parted by MARK, whose id no other word has."""
        runs = [f" {MARK} ".join([*words[k : k + RUN], ""]) for k in range(0, len(words), RUN)]
        ids = self._joined(self.tok, runs)
        mark = ids == self.mark
        return ids[~mark], np.diff(np.flatnonzero(mark), prepend=-1) - 1

    def ids_of_simple(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of simple words: their parts go to the library, and the last id of each part is one that ends a word."""
        parts = [(w,) if w.isalpha() else _PARTS.findall(w) for w in words]
        flat = [p for own in parts for p in own]
        ids = self._joined(self.model, [" ".join(flat[k : k + RUN]) for k in range(0, len(flat), RUN)])
        behind = np.flatnonzero(self.ends[ids])[np.cumsum([len(own) for own in parts]) - 1] + 1
        return ids, np.diff(behind, prepend=0)

    def _joined(self, tok, runs: list[str]) -> np.ndarray:
        return np.concatenate([np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(runs, add_special_tokens=False)])

    def add(self, words: list[str]) -> np.ndarray:
        """Puts new words; where each of them went, counted from the first one put."""
        fits = np.fromiter((_SIMPLE.fullmatch(w) is not None for w in words), bool, len(words))
        order = np.argsort(~fits, kind="stable")
        n, own = int(fits.sum()), [words[i] for i in order.tolist()]
        for ids_of, a, b in ((self.ids_of_simple, 0, n), (self.ids_of, n, len(own))):
            for k in range(a, b, 10_000):
                part = own[k : min(b, k + 10_000)]
                self.put(part, *ids_of(part))
        out = np.zeros(len(words), np.int64)
        out[order] = np.arange(len(words))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        out: list = [None] * len(texts)
        plain = [i for i, text in enumerate(texts) if "<|" not in text and _PLAIN.fullmatch(text)]
        for i in set(range(len(texts))).difference(plain):
            out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        if len(self.at) > MAX_WORDS:
            self.age()
        # each distinct word is looked up once; a text with white space at its ends has empty words there, which have no ids
        split = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.string()))
        words = split.flatten().dictionary_encode()
        distinct, index = words.dictionary.to_pylist(), words.indices.to_numpy()
        at = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(missing := np.flatnonzero(at < 0)):
            first = len(self.at)
            new = [distinct[i] for i in missing.tolist()]
            at[missing] = first + self.add(new)
        self.uses[: len(self.at)] += np.bincount(at, np.bincount(index, minlength=len(at)), len(self.at)).astype(np.int64)
        ids, ends = self.gather(at[index])
        at_id = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        for k, i in enumerate(plain):
            out[i] = ids[at_id[k] : at_id[k + 1]]
        return out


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]
