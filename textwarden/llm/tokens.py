"""Token ids of whole texts by a public tokenizer, word by word, with the words a worker has met kept."""

from __future__ import annotations

import os
from array import array
from itertools import chain
from unicodedata import is_normalized

import numpy as np

from textwarden.llm.worker_memory import remembered

# A worker forgets its words when it holds so many.
WORDS = 500_000


def _words(raw: bytes) -> list[bytes]:
    """What stands between ASCII blanks; in lower case, but where special tokens may be spelled out."""
    return (raw if b"<|" in raw else raw.lower()).split()


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for; ``new`` has those not dealt with yet."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTokenizer:
    """Encodes what stands between ASCII blanks on its own.

    Right for tokenizers that put texts into lower case, split at white space and drop it before they merge, as
    ``word_bpe_49k`` does: nothing in them reaches over a blank, so the ids of a text are those of its words in a row.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.merge = self.tokenizer.model.tokenize
        # The characters that stand for bytes, as the library writes them.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x250)}
        self.marks = {m: self._encoded([m])[0].ids for m in ".,"}
        self._forget()

    def _forget(self) -> None:
        self.words = _Numbers()
        # Buffers are never empty: one unused place.
        self.ids, self.starts = array("I", [0]), array("q", [1])

    def _encoded(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _merged(self, word: str) -> list[int] | None:
        """Ids of a word of plain letters, with a point or comma after it; None for other words.

        Letters are one piece for the tokenizer, and a point after them another; only the merges are left to do.
        """
        mark = word[-1]
        stem = word[:-1] if mark in self.marks else word
        if not stem.isalpha() or stem != stem.lower():
            return None
        if not stem.isascii():
            if max(stem) >= "\u0250" or not is_normalized("NFC", stem):
                return None
            stem = stem.translate(self.letters)
        ids = [t.id for t in self.merge(stem)]
        return ids + self.marks[mark] if mark in self.marks else ids

    def _learn(self) -> None:
        """Ids of the words not met before."""
        found = [self._merged(w.decode()) for w in self.words.new]
        odd = [i for i, ids in enumerate(found) if ids is None]
        for i, encoding in zip(odd, self._encoded([self.words.new[i].decode() for i in odd]), strict=True):
            found[i] = encoding.ids
        self.ids.extend(chain.from_iterable(found))
        self.starts.frombytes((self.starts[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)).tobytes())
        self.words.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text as unsigned 32-bit numbers."""
        if len(self.words) > WORDS:
            self._forget()
        number = self.words.__getitem__
        places = []
        for text in texts:
            words = _words(text.encode())
            places.append(np.fromiter(map(number, words), np.int64, len(words)))
        if self.words.new:
            self._learn()
        starts, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ids, np.uint32)
        out = []
        for at in places:
            first, count = starts[at], starts[at + 1] - starts[at]
            out.append(ids[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        del starts, ids
        return out


def word_tokenizer(definition: str) -> WordTokenizer:
    """The worker's tokenizer, with the words it has met in earlier tasks."""
    return remembered(("tokens", definition), lambda: WordTokenizer(definition))
