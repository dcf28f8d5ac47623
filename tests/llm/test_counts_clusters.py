"""HyperMinHash classes, dimension-sharded k-means and phrase collocations against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.llm import hyperminhash as hm
from weftlink.llm.collocations import collocations, phrase_counts
from weftlink.llm.dim_kmeans import lloyd, partial_distances
from weftlink.llm.word_index import WordIndex, suffix_order


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# HyperMinHash


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a & b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            first[find(i)] = min(first.get(find(i), key), key)
    out = []
    for i, (key, _) in enumerate(rows):
        component = first.get(find(i)) if sets[i] else key
        out.append((key, len(sets[i]), component, key == component))
    return Counter(out)


def chained_texts():
    """Families of texts a few words apart, so that classes hang together by chains; and odd rows."""
    rng = np.random.default_rng(3)
    word, rows, key = [f"W{i}" for i in range(300)], [], 0
    for n in (1, 4, 9, 30, 60, 150, 400):
        base = list(rng.choice(word, n))
        for step in range(14):
            rows.append((key, " ".join(base)))
            key += 1
            for at in rng.integers(0, n, 1 if step % 3 else max(1, n // 60)):
                base[at] = str(rng.choice(word))
    long_text = " ".join(map(str, range(30_000)))
    odd = [(key, None), (key + 1, ""), (key + 2, " \n\t"), (key + 3, "É b c d e f"), (key + 4, "é b c d e f"), (key + 5, "A\tb\x0bC"), (key + 6, "a B c")]
    odd += [(key + 7, long_text), (key + 8, long_text + " more"), (None, "a b c"), (None, None), (None, "quite alone here"), (key + 3, "É b c d e f"), (0, "again")]
    return rows + odd


def test_near_duplicates_equal_brute_force(spark):
    rows = chained_texts()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, root string, set_id int").repartition(3)
    got = hm.near_duplicates(df, block=8).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, bool(r.kept)) for r in got) == brute_classes(rows)
    empty = hm.near_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_sketches_keep_leading_zeros_and_mantissa():
    for h in (1 << 63, (5 << 57) | (1 << 56), (5 << 57) | (3 << 40), (9 << 57) | 1):
        regs = hm.sketches(np.array([h], dtype=np.uint64), np.array([1]))[0]
        bucket, rest = h >> 57, h & ((1 << 57) - 1)
        assert np.flatnonzero(regs).tolist() == [bucket]
        if rest >= 1 << 5:
            zeros = 57 - rest.bit_length()
            mantissa = (rest << zeros >> 46) & 1023
            assert regs[bucket] == ((zeros + 1) << 10) | mantissa
    assert (hm.densified(hm.sketches(np.array([7 << 57], dtype=np.uint64), np.array([1]))) > 0).all()


def test_estimates_are_corrected_for_collisions(monkeypatch):
    """With few mantissa bits disjoint sets agree by chance; the estimate takes that off."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(hm, "MANTISSA", 3)
    hm.chance_collision.cache_clear()
    sizes = np.full(60, 2000)
    regs = hm.sketches(np.concatenate([np.sort(rng.integers(0, 2**64, 2000, dtype=np.uint64)) for _ in sizes]), sizes)
    raw = (regs[:30, None] == regs[None, 30:]).mean()
    likely, _ = hm.estimates(regs[:30], regs[30:], sizes[:30], sizes[30:])
    assert raw == pytest.approx(hm.chance_collision(2000, 2000), rel=0.1)
    assert (np.maximum(likely - 0.03, 0)).mean() < raw / 10  # nothing is left but the spread around 0
    hm.chance_collision.cache_clear()


# k-means


def plain_lloyd(rows, clusters=40, rounds=5):
    kept = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted((hashlib.sha256(f"2:{k}".encode()).hexdigest(), v) for k, v in kept if k is not None)[:clusters]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        centres = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centres)]
    out = [(k, *assign(v)) for k, v in kept]
    inertia = Counter()
    for _, d, c in out:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((k, c, d, inertia[c], sum(inertia.values()), sha[c]) for k, d, c in out)


def got_clusters(df, **more):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in lloyd(df, **more).collect())


def test_lloyd_equals_plain_version(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 1, 64)]) for i in range(120)]
    rows += [(200 + i, list(rows[i % 7][1])) for i in range(30)] + [(3, rows[3][1]), (None, rows[4][1])]
    bad = rows[0][1]
    rows += [(300, None), (301, []), (302, bad[:63]), (303, bad + [0.0]), (304, [*bad[:63], None]), (305, [*bad[:63], math.nan]), (306, [*bad[:63], math.inf])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, cluster int, block string").repartition(3)
    assert got_clusters(df, chunk=16) == plain_lloyd(rows)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert got_clusters(few) == plain_lloyd(rows[:3])
    assert lloyd(df.limit(0)).count() == 0
    # dimensions that the shards do not divide, ties, and a value too large for exact distances
    small = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [0.0, 1.0, 2.0]), (3, [1e9, 0.0, 0.0])], "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.cluster, r.distance) for r in lloyd(small, dimensions=3, shard=2, clusters=2).collect()}
    assert found == {1: (0, 0), 2: (0, 0)}


@pytest.mark.parametrize("top", [100, 1 << 26])
def test_partial_distances_are_exact(top):
    rng = np.random.default_rng(2)
    x, c = rng.integers(-top, top, (20, 16)), rng.integers(-top, top, (5, 16))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, k, strict=True)) for k in c] for r in x]
    assert partial_distances(x, c).tolist() == want


# collocations


def plain_collocations(rows, words=3, least=10, inside=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        parts = lambda q, m: {q[i : i + m] for i in range(len(q) - m + 1)}
        if any(g == lang and len(q) > len(p) and p in parts(q, len(p)) and 100 * b >= inside * a for (g, q), b in candidates.items()):
            continue
        score, _, left, right = min(
            (1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))
        )
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked, place = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, left, right, n[lang], -score))
    return Counter(ranked)


def phrase_rows():
    rng = np.random.default_rng(11)
    word = [f"w{i}" for i in range(14)] + ["É", "é", "Zß", "日本", "x-y", "a b"]
    rows = []
    for i in range(160):
        some = rng.choice(word, rng.integers(0, 50), p=np.r_[0.2, np.full(19, 0.8 / 19)])
        text = "".join(str(w) + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", "! "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for w in some)
        rows.append((["de", "en", None, "und"][i % 4], text))
    rows += [("en", "New York City hall. " * 40), ("en", "ha ha ha ha ha " * 10), ("fr", None), ("fr", ""), ("fr", " .,; \n")]
    return rows + [("xx", " ".join(f"u{i}" for i in range(20_000)))] + [("en", "the same row here")] * 12


def test_collocations_equal_plain_version(spark):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)
    for top, shard in ((2000, 1 << 20), (5, 300)):
        got = collocations(df, top=top, shard_words=shard).collect()
        columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert Counter(tuple(r[c] for c in columns) for r in got) == plain_collocations(rows, top=top)
    four = collocations(df.filter("lang = 'en'"), words=4, least=5).collect()
    want = plain_collocations([r for r in rows if r[0] == "en"], words=4, least=5)
    assert Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in four) == want
    assert collocations(df.limit(0)).count() == 0


def test_phrases_know_how_they_go_on(spark):
    counted, _ = phrase_counts(spark.createDataFrame([("en", "a b c. a b. b c")], "lang string, text string"), least=1)
    got = {r.phrase: (r.f, r.goes_left, r.goes_right) for r in counted.filter(F.col("n_words") <= 2).collect()}
    assert got == {"a": (2, 0, 2), "b": (3, 2, 2), "c": (2, 2, 0), "a b": (2, 0, 1), "b c": (2, 1, 0)}


def test_word_index_intervals_in_both_directions():
    rng = np.random.default_rng(4)
    seq = np.append(rng.integers(0, 4, 300), 0)
    order = suffix_order(seq).tolist()
    ends = np.flatnonzero(seq == 0).tolist()
    key = lambda i: [*[(1, int(s)) for s in seq[i : next(e for e in ends if e >= i)]], (0, next(e for e in ends if e >= i))]
    assert order == sorted(range(len(seq)), key=key)
    index = WordIndex.build(seq)
    pieces = "".join(map(str, seq)).split("0")
    found = index.single()
    for grow in (index.right, index.left, index.right):
        found = grow(found)
        want = Counter(p[i : i + found.words.shape[1]] for p in pieces for i in range(len(p) - found.words.shape[1] + 1))
        assert {"".join(map(str, w)): n for w, n in zip(found.words.tolist(), found.count.tolist(), strict=True)} == want
        for words, start, n in zip(found.words.tolist(), found.forward.tolist(), found.count.tolist(), strict=True):
            assert all(seq[i : i + len(words)].tolist() == words for i in order[start : start + n])
