"""Byte-level BPE by backtracking over longest matches."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import slices, texts_of

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Entries that each of a worker's memos keeps; above it the memo starts anew. A bound on memory, it changes no result.
MEMO, WORDS = 400_000, 600_000
SLICE_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encodes one piece of bytes in time linear in its length.

    The ids are those of merging the neighbours of lowest rank first. A row of tokens is that result if and only if
    each token and each pair of neighbours is a result of its own, so the encoder walks from the longest match at a
    place to shorter ones, and steps back where no neighbour fits. Places it stepped back from are marked and not
    tried again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.sizes = {i: len(t) for t, i in ranks.items()}
        # how each token is made: the two tokens of its last merge; a token that merges can't make has none
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        made = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                rest = self._merge(token, rank)
                if len(rest) != 2:
                    continue
                self.parts[rank] = rest[0], rest[1]
                self.merged[rest[0], rest[1]] = rank
            made.append(token)
        self.automaton = ahocorasick.Automaton()
        for token in made:
            self.automaton.add_word(token.decode("latin-1"), (ranks[token], len(token)))
        self.automaton.make_automaton()
        reachable = set(made)
        self.shorter = {}  # the longest token that a token begins with, other than itself
        for token in made:
            self.shorter[ranks[token]] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reachable), -1)
        self.fits: dict[tuple[int, int], bool] = {}

    def _merge(self, piece: bytes, below: int) -> list[int]:
        """Plain merging with the ranks under ``below``; used on single tokens, to learn how they are made."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]  # noqa: B905
            low = min(found)
            if low >= below:
                break
            at = found.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives just these two.

        The later of the two merges is taken apart, again and again. Should the parts that then touch have a merge
        that comes before what was taken apart, merging would have crossed the border.
        """
        pair, limit, whole = (left, right), 1 << 62, self.merged
        while True:
            across = whole.get((left, right))
            if across is not None and across < limit:
                self._keep(pair, False)
                return False
            # a tie goes to the left token: of equal merges the leftmost is done first
            if left > right and left in self.parts:
                limit, left = left, self.parts[left][1]
            elif right in self.parts and (right >= left or left not in self.parts):
                limit, right = right + 1, self.parts[right][0]
            elif left in self.parts:
                limit, left = left, self.parts[left][1]
            else:
                self._keep(pair, True)
                return True

    def _keep(self, pair: tuple[int, int], fits: bool) -> None:
        if len(self.fits) >= MEMO:
            self.fits.clear()
        self.fits[pair] = fits

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        sizes, fits, n = self.sizes, self.fits, len(piece)
        # most pieces are the longest match, then the longest match of the rest, and so on
        out = [token for _, (token, _) in self.automaton.iter_long(text)]
        for pair in zip(out, out[1:]):  # noqa: B905
            known = fits.get(pair)
            if known is None:
                known = self._compatible(*pair)
            if not known:
                break
        else:
            if sum(map(sizes.__getitem__, out)) == n:
                return out
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(text):
            longest[end - size + 1] = token  # ends ascend, so the longest comes last
        shorter = self.shorter
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while at < n:
            end = at + sizes[token]
            if not dead[end]:
                known = fits.get((out[-1], token)) if out else True
                if known is None:
                    known = self._compatible(out[-1], token)
                if known:
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: step back and try shorter ones there
                dead[at] = 1
                last = out.pop()
                at -= sizes[last]
                token = shorter[last]
        return out


class TextEncoder:
    """Ids of texts, each match of the pattern on its own; memos hold the ids of words and of matches."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(read_ranks(path))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.words: dict[str, str] = {}
        self.matches: dict[str, str] = {}
        self.blank_before_blank = re.compile(r"\s ")

    def _match(self, match: str) -> str:
        ids = self.matches.get(match)
        if ids is None:
            if len(self.matches) >= MEMO:
                self.matches.clear()
            ids = self.matches[match] = ",".join(map(str, self.bpe.encode(match.encode())))
        return ids

    def _word(self, word: str) -> str:
        # letters after at most one blank are one match, and so is a single mark behind them
        if word[word[:1] == " " :].isalpha():
            return self._match(word)
        if word[-1:] in ".," and word[word[:1] == " " : -1].isalpha():
            return f"{self._match(word[:-1])},{self._match(word[-1])}"
        return ",".join(map(self._match, self.pattern.findall(word)))

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas.

        A match never goes on past a blank unless white space comes before that blank, so else a text is cut before
        its blanks and the parts are looked up.
        """
        if not text:
            return ""
        if text[0] == " " or text[-1] == " " or self.blank_before_blank.search(text):
            return ",".join(map(self._match, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        words, memo = [first, *(f" {w}" for w in rest)], self.words
        out = list(map(memo.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    word = words[i]
                    if len(memo) >= WORDS:
                        memo.clear()
                    out[i] = memo[word] = self._word(word)
        return ",".join(out)


@functools.lru_cache(maxsize=2)
def text_encoder(path: str = RANK_FILE) -> TextEncoder:
    """One encoder a worker process."""
    return TextEncoder(path)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str = RANK_FILE) -> dict[str, bytes]:
    return {str(i): token for token, i in read_ranks(path).items()}


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANK_FILE) -> DataFrame:
    """``key, ids``: the ids of each whole text as decimal numbers joined by commas; none for a null or empty text.

    One row for each row of ``docs``, repeated ones too; null keys stay null. Other columns are not read.
    """
    return _by_text(docs, key, text, "ids", lambda: text_encoder(path).encode)


def _by_text(docs: DataFrame, key: str, text: str, name: str, maker, more: dict | None = None) -> DataFrame:
    key_type = docs.schema[key].dataType.simpleString()
    columns = {name: "string", **(more or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = maker()
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                results = list(map(made, texts_of(rows, "text")))
                columns_out = zip(*results, strict=True) if more else [results]
                yield pa.RecordBatch.from_arrays([rows.column("key"), *map(pa.array, columns_out)], names=["key", *columns])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"key {key_type}, " + ", ".join(f"{n} {t}" for n, t in columns.items())
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = RANK_FILE) -> DataFrame:
    """``key, text`` as bytes, from decimal ids joined by commas. An id outside the file raises."""
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path).__getitem__
        for batch in batches:
            for rows in slices(batch, "ids", SLICE_BYTES):
                texts = [b"".join(map(known, t.split(","))) if t else b"" for t in texts_of(rows, "ids")]
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(texts, pa.binary())], names=["key", "text"])

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {key_type}, text binary").withColumnRenamed("key", key)


def byte_bpe_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANK_FILE) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each text: encoded, and its ids decoded, in one pass."""

    def maker():
        encode, known = text_encoder(path).encode, token_bytes(path).__getitem__

        def digest(t: str) -> tuple[str, int, str]:
            ids = encode(t)
            tokens = ids.split(",") if ids else []
            decoded = b"".join(map(known, tokens))
            return hashlib.sha256(ids.encode()).hexdigest(), len(tokens), hashlib.sha256(decoded).hexdigest()

        return digest

    made = _by_text(docs, key, text, "ids_sha256", maker, {"n_tokens": "long", "decoded_sha256": "string"})
    return made.select(key, "n_tokens", "ids_sha256", "decoded_sha256")
