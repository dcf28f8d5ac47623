"""Chat formatting by exact round trips, vector search against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlink.llm.chat import (
    CHAT_FILE, chat_tokenizer, conversation_digests, escape, format_conversations, loss_mask, masked_texts, parse, render, unescape,
)
from weftlink.llm.vector_search import nearest

PIECES = st.lists(st.sampled_from(["### ", "#", "\\", "<text>", "</turn>", "\n", " ", "<", "/", "a", ": ", "é", "👍", "\\## "]))


@given(PIECES.map("".join))
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    escaped = escape(text)
    assert unescape(escaped) == text
    assert not any(mark in escaped for mark in ("### ", "<text>", "</turn>"))


@given(st.lists(st.tuples(PIECES.map("".join), PIECES.map("".join)), max_size=4))
@settings(max_examples=100, deadline=None)
def test_render_mask_and_parse(turns):
    formatted, spans = render(turns)
    assert parse(formatted) == turns
    encoded = chat_tokenizer(CHAT_FILE).encode(formatted, add_special_tokens=False)
    offsets = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
    mask = loss_mask(offsets, spans[::2])
    got = [unescape(t) for t in masked_texts(formatted, offsets[:, 0], offsets[:, 1], mask)]
    assert got == [text for _, text in turns[::2] if text]


def test_conversations(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [
        (1, 1, "assistant", " two \n"), (1, 0, "user", "one"), (1, 2, None, None), (1, 3, "assistant", None), (1, 3, "assistant", said),
        (None, 0, "assistant", "x"), (2, None, "system", ""), (2, 5, "assistant", "same"), (2, 5, "assistant", "same"),
    ]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    for window in (1 << 20, 1):
        got = {r.conv_id: r for r in conversation_digests(format_conversations(turns, window_chars=window)).collect()}
        assert set(got) == {1, None, 2}
        for key, r in got.items():
            own = sorted(
                ((t, who or "", text or "") for c, t, who, text in rows if c == key), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])
            )
            joined = "".join(f"{who}\n{text}\n" for _, who, text in own)
            learnt = "".join(text for _, who, text in own if who == "assistant")
            assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert r.loss_chars == len(learnt) and r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
            assert r.formatted_chars == len(render([x[1:] for x in own])[0])


def test_parts_have_the_ids_of_the_whole(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f" \n{i} text\n ") for i in range(9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = format_conversations(turns).collect()
    parts = sorted(format_conversations(turns, window_chars=20).collect(), key=lambda r: r.part)
    assert len(whole) == 1 and len(parts) > 2
    assert [i for r in parts for i in r.ids] == whole[0].ids
    assert [i for r in parts for i in r.loss_mask] == whole[0].loss_mask
    assert format_conversations(turns.limit(0)).count() == 0


def brute(queries, rows, k):
    got = []
    for q, x in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in rows if i != q and len(y) == len(x))
        got += [(q, r, i, pytest.approx(d, rel=1e-12)) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(got, key=lambda x: x[:2])


def search(df, k, **blocks):
    rows = nearest(df.filter("vec_id % 10 = 0"), df, k=k, **blocks).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows)


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e9])
def test_nearest_equals_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)) * scale
    x[50:120] = x[50]
    x[200:204] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    want = brute([r for r in rows if r[0] % 10 == 0], rows, 10)
    assert search(df, 10, query_block=7, candidate_block=64) == want


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []),
        (10, [0.5, 0.5]), (20, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (11, [0.5, 0.5]), (11, [0.5, 0.5]), (12, [2.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (10, [0.5, 0.5]), (11, [0.5, 0.5]), (12, [2.0, 0.0]), (20, [1.0, 0.0, 0.0])]
    assert search(df, 10) == brute([r for r in good if r[0] % 10 == 0], good, 10)
    assert search(df.limit(0), 10) == []
