"""Token store and packing against the tokenizers library and plain counting."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftlink.llm.packing import pack, pack_documents, sequences, sum_of_squares
from weftlink.llm.token_store import build_mph, crc_of_ids, mph_slots, stored_token_digests, write_token_store
from weftlink.llm.word_ids import WORD_FILE, word_encoder

TEXTS = [
    "Plain words, twice. Plain words, twice.", "", None, "ΟΔΥΣΣΕΥΣ ΣΑΣ. straße İstanbul", "a .. b ,, c., 'S. it's. x'",
    "tab\tand\r\nnew\x0bline\x1c\x85    x", "été ́x", "<|endoftext|> in <|a text", "word " * 9000,
    "x" * 3000 + " " + "ab," * 500, "日本語 テキスト。 👍🏽 1234 5.6,7", ",", ".", ". , .", "A.,", "'", "naïve, Ünïcode. ǅ ß ẞ",
]


def reference_ids(text):
    return Tokenizer.from_file(WORD_FILE).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 17, t, i, "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, start string").repartition(3)


def test_word_encoder_equals_library():
    encoder = word_encoder(WORD_FILE)
    for _ in range(2):
        for text, raw in zip(TEXTS, encoder.encode([t or "" for t in TEXTS]), strict=True):
            assert np.frombuffer(raw, dtype=encoder.dtype).tolist() == reference_ids(text)[:-1]


def test_store_equals_plain_concatenation(docs):
    want, at = {}, 0
    for key, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        ids = reference_ids(text)
        want[key] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in stored_token_digests(docs).collect()} == want


def test_store_keyed_access(spark):
    rows = [(None, "no key"), (5, "five"), (5, "five"), (5, "other five"), (9, "nine"), (-3, None)]
    store = write_token_store(spark.createDataFrame(rows, "k long, text string"), "k")
    asked = spark.createDataFrame([(5,), (5,), (None,), (77,), (-3,)], "k long")
    got = store.read(store.look_up(asked, "k")).orderBy("start").collect()
    assert [r.key for r in got] == [None, -3, 5, 5, 5]
    by_key = {}
    for r in got:
        by_key.setdefault(r.key, []).append(r.ids)
    assert by_key[None] == [reference_ids("no key")] and by_key[-3] == [[1]]
    assert sorted(by_key[5]) == sorted(map(reference_ids, ["five", "five", "other five"]))
    assert got[0].start == 0 and got[1].start == got[0].n_tokens


def test_store_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert stored_token_digests(empty).count() == 0


def test_store_takes_text_keys(spark):
    docs = spark.createDataFrame([("b", "two"), ("a", "one")], "doc_id string, text string")
    store = write_token_store(docs)
    rows = store.read(store.look_up(docs, "doc_id"), crc_of_ids, "c long").orderBy("start").collect()
    assert [(r.key, r.c) for r in rows] == [("a", crc(reference_ids("one"))), ("b", crc(reference_ids("two")))]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        h1, h2 = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
        levels = build_mph(h1, h2)
        assert sorted(mph_slots(levels, h1, h2).tolist()) == list(range(n))


def brute_sum_of_squares(lengths, capacity):
    """One bin after another, with the whole sum worked out for every choice."""
    gaps, where = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        best = None
        for b in sorted(range(len(gaps) + 1), key=lambda b: gaps[b] if b < len(gaps) else capacity + 1):
            after = [*gaps, capacity] if b == len(gaps) else list(gaps)
            if after[b] < lengths[i]:
                continue
            after[b] -= lengths[i]
            counts = np.bincount([g for g in after if g], minlength=1)
            cost = int((counts**2).sum())
            if best is None or cost < best[0]:
                best = cost, after
        gaps = best[1]
        where.append(sorted(gaps))
    return sorted(gaps)


def test_sum_of_squares_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 13, rng.integers(1, 25))
        bins, offsets = sum_of_squares(lengths, 12)
        used = np.bincount(bins, weights=lengths).astype(int)
        assert sorted((12 - used).tolist()) == brute_sum_of_squares(lengths.tolist(), 12)
        for b in set(bins.tolist()):
            inside = sorted((int(o), int(n)) for o, n, x in zip(offsets, lengths, bins, strict=True) if x == b)
            assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside])[:-1].tolist()


def test_packing_is_tight():
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 20000).astype(int) + 1)
    bins, _ = sum_of_squares(lengths, 4096)
    assert bins.max() + 1 <= 1.002 * -(-lengths.sum() // 4096) + 1


def test_pieces_and_sequences(spark, docs):
    rows = pack_documents(docs, keep_ids=True).cache()
    parts = {}
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(parts.setdefault(r.doc_id, [])) and r.length == len(r.ids) and r.ids_crc32 == crc(r.ids)
        assert r.piece == r.start // 4096 and r.start % 4096 == 0
        parts[r.doc_id] += r.ids
    assert parts == {r.doc_id: reference_ids(r.text) for r in docs.collect()}
    for s in sequences(rows).collect():
        assert sum(s.lengths) == len(s.ids) <= 4096
    placed = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert placed.filter("n != e").count() == 0
    rows.unpersist()


def test_pack_keeps_other_columns_and_checks_lengths(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 10, None)], "_group int, length int, offset string")
    got = pack(rows.withColumnRenamed("_group", "g"), capacity=10).collect()
    assert sorted((r.g, r.length, r.offset) for r in got) == [(1, 5, 0), (1, 5, 5), (2, 10, 0)]
    assert len({r.sequence_id for r in got}) == 2
    with pytest.raises(Exception, match="lengths must be"):
        pack(spark.createDataFrame([(None,), (3,)], "length int"), capacity=10).collect()
    assert pack(spark.createDataFrame([], "length int")).count() == 0
