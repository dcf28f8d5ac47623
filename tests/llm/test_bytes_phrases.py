"""Byte BPE against the tiktoken library, fingerprints against direct forms of their definition."""

import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN

from weftlink.llm.byte_bpe import RANK_FILE, byte_bpe_digests, decode_ids, encode_texts, read_ranks, text_encoder
from weftlink.llm.phrases import (
    as_text, document_fingerprints, edit_sensitivity, edited_text, fingerprints, from_text, likeness, phrase_names,
)

PIECES = ["  ", " ", "\n", "\t", "'s", "ab", "the", " the", "1", "٣", "\x1c", "\xa0", ".", "..", "é", "日本", "👍", "a a", "tion", "zzzz", "­"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANK_FILE), special_tokens={})


@given(st.one_of(st.lists(st.sampled_from(PIECES)).map("".join), st.text(max_size=40), st.text("abcdefghinorst", max_size=60)))
@settings(max_examples=800, deadline=None)
def test_ids_equal_the_library(text):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=text_encoder(RANK_FILE).bpe.ranks, special_tokens={})
    assert [int(i) for i in text_encoder(RANK_FILE).encode(text).split(",") if i] == encoding.encode_ordinary(text)


def test_long_pieces(library):
    for text in ("a" * 30000, "ab" * 5000 + "q" * 777, "é👍" * 3000, "=" * 4001):
        assert [int(i) for i in text_encoder(RANK_FILE).encode(text).split(",")] == library.encode_ordinary(text)


TEXTS = ["Hello  world", "", None, "x" * 5000, "It's 42. " * 30, "Hello  world", "日本語\n\n ", " lead", "tail ", "a\t b"]


def test_bpe_query(spark, library):
    docs = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in byte_bpe_digests(docs).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        r = got[i or None]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.text).decode() for r in decode_ids(encode_texts(docs)).collect()}
    assert back == {i or None: t or "" for i, t in enumerate(TEXTS)}
    assert byte_bpe_digests(docs.limit(0)).count() == 0


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


def test_equal_substrings_share_interior_phrases():
    rng = np.random.default_rng(1)
    shared = words(rng, 400)
    texts = [words(rng, 37) + shared + words(rng, 11), words(rng, 90) + shared, shared]
    for level, (owner, names) in enumerate(phrase_names(texts), 1):
        own = [set(names[owner == i].tolist()) for i in range(3)]
        if level <= 4:  # all phrases of the shared part but a few at its ends
            for other in own[:2]:
                assert len(own[2] - other) <= 8
    a, b, _ = fingerprints(texts)
    assert likeness(a, b) > 0.7


def test_fingerprints_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    texts = ["", "a", "ab", "aaaaaaa", "aa", "abab" * 50, "x" * 100, "é👍", *(words(rng, n) for n in (1, 3, 30, 300, 3000)), ""]
    together = [as_text(f) for f in fingerprints(texts)]
    assert together == [as_text(fingerprints([t])[0]) for t in texts]
    assert len(set(together)) == len(set(texts)) and together[0] == ""
    for f in fingerprints(texts):
        assert from_text(as_text(f)).tolist() == f.tolist() == sorted(set(f.tolist()))


def test_kept_names_are_the_smallest():
    rng = np.random.default_rng(3)
    for text in (words(rng, 2000), words(rng, 5) * 400, words(rng, 100)):
        names = [n for level, (_, n) in enumerate(phrase_names([text]), 1) if level >= 2]
        every = np.unique(np.concatenate(names))
        assert fingerprints([text])[0].tolist() == every[: max(64, int((every < 2**60).sum()))].tolist()


def test_long_texts_keep_the_signatures_of_a_shared_passage():
    rng = np.random.default_rng(5)
    passage = words(rng, 200)
    texts = [words(rng, n) + passage + words(rng, 20_000 - n) for n in (3_000, 15_000)] + [words(rng, 20_000)]
    a, b, other, own = (set(f.tolist()) for f in fingerprints([*texts, passage]))
    low = {n for n in own if n < 2**60} - other  # what the passage keeps anywhere, and not only by common short phrases
    assert len(low) >= 8 and len(low & a & b) >= 0.7 * len(low) and len(a) > 1000


def test_likeness_follows_edits():
    rng = np.random.default_rng(4)
    a, b = words(rng, 500), words(rng, 500)
    fa, fb, half = fingerprints([a, b, edited_text(a, b)])
    assert likeness(fa, fa) == 1 and likeness(fa, fb) < 0.1 and 0.25 < likeness(fa, half) < 0.75
    none = np.empty(0, dtype=np.uint64)
    assert likeness(none, none) == 1 and likeness(none, fa) == 0


def test_edit_query(spark):
    rng = np.random.default_rng(5)
    texts = [words(rng, int(n)) for n in rng.integers(1, 60, 5000)]
    rows = [(i * 3 - 7, t if i % 97 else None, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in edit_sensitivity(docs).collect()}
    assert len(got) == len(rows)
    for (key, a, _), (_, b, _) in list(zip(rows, rows[1:] + rows[:1], strict=True))[::50] + [(rows[-1], rows[0])]:
        a, b = a or "", b or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        fa, fe, fb = fingerprints([a, edited, b])
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(fa), as_text(fe))
        assert (r.near_edited, r.near_next) == (likeness(fa, fe), likeness(fa, fb))


def test_edit_query_odd_rows(spark):
    schema = "doc_id long, text string"
    one = edit_sensitivity(spark.createDataFrame([(4, "abcdef")], schema)).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(4, 6, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    rows = [(None, "first"), (1, "same"), (1, "same"), (2, None)]
    got = edit_sensitivity(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 0, 5), (True, 1, 4), (True, 1, 4), (True, 2, 0)]
    assert edit_sensitivity(spark.createDataFrame([], schema)).count() == 0
    prints = document_fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert len(prints) == 4 and {r.fingerprint for r in prints if r.doc_id == 2} == {""}
