"""Token ids of texts by a public tokenizer whose pieces never span white space, with the ids of words remembered."""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np

#: Words that a worker remembers. Beyond it, it starts anew.
KEPT_WORDS = 300_000
#: Words that are tokenized in one string.
JOINED_WORDS = 256


#: Marks that end a run of letters and are a piece of their own: ASCII, without the apostrophe of contractions and the
#: characters of special tokens.
_MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordTokenizer:
    """ids of `Tokenizer.encode(text, add_special_tokens=False)`, found word by word.

    The tokenizer lower-cases, drops white space and splits there before anything else, so a text's ids are the ids of
    its words in a row. A word that is not remembered is tokenized once. Words of letters only are one piece, which ends
    in the one id marked as a word's end, so many of them can be tokenized in one string. Marks after such a word are a
    piece of their own, remembered apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 3, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.lengths, self.starts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _room(self, words: int, ids: int) -> None:
        for name, used in (("lengths", words), ("starts", words), ("flat", ids)):
            array = getattr(self, name)
            if used > len(array):
                setattr(self, name, np.concatenate([array, np.zeros(used, array.dtype)]))

    def _keep(self, words: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self._room(len(self.numbers), self.used + len(ids))
        self.lengths[words] = lengths
        self.starts[words] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _ids_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids in a row) of remembered words."""
        n = self.lengths[words]
        ends = np.cumsum(n)
        return n, self.flat[np.repeat(self.starts[words] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _learn(self) -> None:
        numbers, fresh = self.numbers, self.numbers.fresh
        first, letters, others, pairs = len(numbers) - len(fresh), [], [], []
        for i, word in enumerate(fresh, first):   # grows on the way: the parts of a word are words
            text = word.decode()
            core = text.rstrip(_MARKS)
            if text.lower().isalpha():   # a lower-case letter may be a letter and a mark
                letters.append((i, text))
            elif core != text and core.lower().isalpha():
                pairs.append((i, numbers[core.encode()], numbers[text[len(core) :].encode()]))
            else:
                others.append((i, text))
        lines = [" ".join(t for _, t in letters[k : k + JOINED_WORDS]) for k in range(0, len(letters), JOINED_WORDS)]
        made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(made) if made else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(letters):
            self._keep(np.array([i for i, _ in letters], np.int64), np.diff(ends, prepend=0), ids)
        else:   # a letter that the tokenizer's normal form takes apart
            others += letters
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)]
        self._keep(np.array([i for i, _ in others], np.int64), np.array(list(map(len, alone)), np.int64),
                   np.fromiter(chain.from_iterable(alone), np.uint32))
        if pairs:
            at = np.array(pairs, np.int64)
            n, ids = self._ids_of(at[:, 1:].ravel())
            self._keep(at[:, 0], n.reshape(-1, 2).sum(1), ids)
        numbers.fresh = []

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, ids per text) of UTF-8 texts."""
        if len(self.numbers) > KEPT_WORDS:
            self.forget()
        split = [t.lower().split() for t in texts]   # lower-cases ASCII letters only, as the tokenizer would
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.numbers.fresh:
            self._learn()
        n, ids = self._ids_of(words)
        ends = np.cumsum(n)
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(edge)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(path)
