"""Ids of whole texts by a tokenizer file that drops white space, with a bounded memo of words."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
#: Words kept in a worker's memo; above it the memo starts anew with the words at hand. A bound on memory, it
#: changes no result.
MEMO_WORDS = 800_000
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


class WordEncoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` does, word by word.

    The tokenizer turns runs of white space into gaps between its pieces, so a text's ids are its words' ids in
    order, and a word need be encoded once. Words not yet known go to the library together. Texts with control
    characters or with the text of a special token go to it whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special]
        self.special = [token.content for _, token in special]
        self.end_id = special[-1][0]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        # for words of letters in lower case only, the model alone: a word is one piece, and its last id says so
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    def _cut(self, ids: list[int], ends: np.ndarray, gap: int) -> list[bytes]:
        width = self.dtype.itemsize
        raw = np.array(ids, dtype=self.dtype).tobytes()
        stops = (ends * width).tolist()
        starts = [0, *((ends + gap) * width).tolist()]
        return [raw[a:b] for a, b in zip(starts, stops, strict=False)]

    def _letter_words(self, words: list[str]) -> list[bytes]:
        ids = self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        return self._cut(ids, np.flatnonzero(self.ends_word[ids]) + 1, 0)

    def _any_words(self, words: list[str]) -> list[bytes]:
        joined = "".join(w + self.special[-1] for w in words)
        ids = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
        return self._cut(ids, np.flatnonzero(np.array(ids) == self.end_id), 1)

    def _learn(self, words: set[str], lower: bool) -> None:
        memo = self.memo
        new = words.difference(memo)
        if not new:
            return
        if len(memo) + len(new) > MEMO_WORDS:
            self.memo = memo = {w: memo[w] for w in words if w in memo}
        # a full stop or comma after a letter is a piece of its own
        marked = {w for w in new if w[-1] in ".," and w[-2:-1].isalpha()}
        ask = new - marked
        ask.update(w[:-1] for w in marked if w[:-1] not in memo)
        ask.update(m for m in ".," if m not in memo)
        letters = [w for w in ask if lower and w.isalpha()]
        others = list(ask.difference(letters))
        for ordered, made in ((letters, self._letter_words), (others, self._any_words)):
            if ordered:
                memo.update(zip(ordered, made(ordered), strict=True))
        memo.update([(w, memo[w[:-1]] + memo[w[-1]]) for w in marked])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        lower: list[list[str] | None] = []
        others: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if _CONTROL.search(text) or any(s in text for s in self.special):
                lower.append(None)
                continue
            low = text.lower()
            if text.isascii() or (
                "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
            ):
                lower.append(low.split())
            else:
                lower.append(None)
                others[i] = text.split()
        self._learn(set().union(*(w for w in lower if w)), True)
        known = self.memo.__getitem__
        out = [None if words is None else b"".join(map(known, words)) for words in lower]
        if others:
            self._learn(set().union(*others.values()), False)
        for i, raw in enumerate(out):
            if raw is None and i in others:
                out[i] = b"".join(map(self.memo.__getitem__, others[i]))
            elif raw is None:
                ids = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
                out[i] = np.array(ids, dtype=self.dtype).tobytes()
        return out


@functools.lru_cache(maxsize=2)
def word_encoder(path: str = WORD_FILE) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path)
