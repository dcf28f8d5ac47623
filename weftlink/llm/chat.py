"""Conversations as training text, with a loss mask aligned to token offsets."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, pre_tokenizers

CHAT_FILE = public_tokenizers.path("byte_bpe_50k.json")
#: Control strings of the template: a turn opens, its text begins, the turn ends.
OPEN, BEGIN, END = "### ", ": <text>", "</turn>\n"
#: Characters of a conversation that are rendered and encoded at a time, cut between turns.
WINDOW_CHARS = 1 << 20


def escape(text: str) -> str:
    """A text without any control string, from which ``unescape`` restores the original."""
    text = text.replace("\\", "\\\\")
    return text.replace("### ", "#\\## ").replace("<text>", "<\\text>").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text of some turns and, for each turn, where its escaped text begins and ends."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{BEGIN}", escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(BEGIN)}(.*?){re.escape(END)}", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@functools.lru_cache(maxsize=2)
def chat_tokenizer(path: str) -> Tokenizer:
    """The tokenizer with the control strings as tokens of their own, so no token crosses the edge of a text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = None  # it would cut blanks off the offsets
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (OPEN, BEGIN, END)])
    return tokenizer


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for each token that lies in one of the spans. Both are sorted; a binary search finds the span of a token."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=np.int8)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return ((at >= 0) & (offsets[:, 1] <= spans[at, 1]) & (offsets[:, 1] > offsets[:, 0])).astype(np.int8)


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn_role: str = "assistant",
    path: str = CHAT_FILE,
    window_chars: int = WINDOW_CHARS,
) -> DataFrame:
    """``conv_id, part, formatted, ids, token_starts, token_ends, loss_mask`` of every conversation.

    The turns are rendered in order, encoded once with offsets, and a token has mask 1 if it lies in the text of a
    turn of ``learn_role``. A conversation that is longer than ``window_chars`` comes in several parts, cut between
    turns; since control strings are tokens, the parts' ids together are the ids of the whole. So a task holds one
    part at a time, also where one conversation has most rows.

    Null texts and roles count as empty. Turns with the same number go by role and text, repeated rows are all
    kept. Rows with a null conversation form one; a null turn comes first. Other columns are not read. No rows give
    no rows.
    """
    key_type = turns.schema[conversation].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]):
        at, part, held, size = object(), 0, [], 0
        for batch in batches:
            for key, who, what in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if key != at or size > window_chars:
                    if held:
                        yield at, part, held
                    part = part + 1 if key == at else 0
                    at, held, size = key, [], 0
                held.append((who, what))
                size += len(what)
        if held:
            yield at, part, held

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(path)
        for key, part, held in windows(batches):
            formatted, spans = render(held)
            encoded = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
            mask = loss_mask(offsets, spans[[who == learn_role for who, _ in held]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key], batch_type),
                    pa.array([part], pa.int32()),
                    pa.array([formatted]),
                    pa.array([encoded.ids], pa.list_(pa.int32())),
                    pa.array([offsets[:, 0]], pa.list_(pa.int64())),
                    pa.array([offsets[:, 1]], pa.list_(pa.int64())),
                    pa.array([mask], pa.list_(pa.int8())),
                ],
                names=["conv_id", "part", "formatted", "ids", "token_starts", "token_ends", "loss_mask"],
            )

    batch_type = pa.string() if key_type == "string" else pa.int64()
    rows = turns.select(
        F.col(conversation).alias("key"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return ordered.mapInArrow(
        encode,
        f"conv_id {key_type}, part int, formatted string, ids array<int>, token_starts array<long>,"
        " token_ends array<long>, loss_mask array<byte>",
    )


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """The stretches of text that neighbouring tokens with mask 1 cover."""
    on = np.flatnonzero(mask)
    if not len(on):
        return
    cuts = np.flatnonzero(np.diff(on) > 1) + 1
    for run in np.split(on, cuts):
        yield formatted[starts[run[0]] : ends[run[-1]]]


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the output."""
    key_type = formatted.schema["conv_id"].dataType.simpleString()
    arrow_type = pa.string() if key_type == "string" else pa.int64()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row(key, n_turns, turns, loss_chars, loss, chars):
        values = [key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
        types = [arrow_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def digest(batches):
        state = None
        for batch in batches:
            starts, ends, masks = (batch.column(c) for c in ("token_starts", "token_ends", "loss_mask"))
            keys, texts = batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()
            for i, (key, text) in enumerate(zip(keys, texts, strict=True)):
                if state is None or state[0] != key:
                    if state:
                        yield row(*state)
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for who, what in parse(text):
                    state[1] += 1
                    state[2].update(f"{who}\n{what}\n".encode())
                token = [c[i].values.to_numpy(zero_copy_only=False) for c in (starts, ends, masks)]
                for learnt in map(unescape, masked_texts(text, *token)):
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
        if state:
            yield row(*state)

    schema = f"conv_id {key_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = formatted.select("conv_id", "part", "formatted", "token_starts", "token_ends", "loss_mask")
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digest, schema)
