"""Toxicity, language and the class model: held-out accuracy and brute-force forms of their parts."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.llm.class_lm import class_likelihood, exchange, fit_class_model, score_texts, words_of
from weftlink.llm.common import share
from weftlink.llm.language import fit_languages, identify, known_language
from weftlink.llm.toxicity import Lexicon, ToxicityModel, distance_allowed, fit_toxicity, needed_terms, plain, quoted, score_toxicity, without_toxic

SYLLABLES = {"xx": ["ba", "ke", "tion", "ol"], "yy": ["über", "keit", "ßa", "sch"], "zz": ["ción", "qué", "lla", "rr"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        lang = ("xx", "yy", "zz")[i % 3]
        words = sentence(rng, lang, int(rng.integers(5, 60))).split()
        bad = i % 5 == 0
        for _ in range(2 * bad):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["dreckling", "worthless", "mistkerlo"])))
        rows.append((i, " ".join(words), lang, int(bad), 0.5))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, score double")
    return df.cache()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(2)
    terms = {"abba": (1.0, True), "abcab": (2.0, True), "bacca": (1.5, False), "abcabcabc": (3.0, True), "ccbbaabbc": (1.0, False)}
    lexicon = Lexicon(terms)
    hits = 0
    for _ in range(4000):
        if rng.random() < 0.6:
            word = list(rng.choice(list(terms)))
            for _ in range(rng.integers(0, 4)):
                word[rng.integers(0, len(word))] = str(rng.choice(["", "a", "b", "c", "ab"]))
            word = "".join(word)
        else:
            word = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
        found = []
        for term, (weight, whole) in terms.items():
            ends = edit_distance(term, word)
            d = ends[-1] if whole else min(ends)
            if d <= distance_allowed(term):
                found.append((d, -weight, term))
        want = min(found, default=None)
        got = lexicon.match(word) if len(word) >= 3 else None
        if len(word) >= 3:
            assert got == ((want[2], want[0]) if want else None), word
            hits += want is not None
    assert hits > 500


def test_misspellings_and_quotation():
    model = ToxicityModel({"worthless": (6.0, True), "moron": (6.0, True)}, frozenset({"maron"}))
    for word in ("worthless", "w0rthless!", "wortless", "w.o.r.t.h.l.e.s.s", "m0ron", "moronn", '"moron"'):
        assert model.hits([word]), word
    assert not model.hits(["maron", "word", "mo", "", "..."])
    words = 'they said "you moron" to him'.split()
    assert quoted(words, words.index('moron"')) and not quoted("you are a moron".split(), 3)
    assert model.features("you are a moron") > model.features("the word moron is an insult")
    assert plain("(Tr@sh!)".lower()) == "trash"
    found = [{"a", "x"}, {"a", "x"}, {"b"}, {"b", "y"}, {"c"}] + [{"a", "b"}] * 3 + [set()] * 12
    assert list(needed_terms({t: (1.0, True) for t in "abcxy"}, found)) == ["a", "b", "x"]
    assert list(needed_terms({t: (1.0, True) for t in "abcxy"}, found + [set()])) == ["a", "b"]


def test_toxicity_held_out(corpus):
    labels = corpus.select("doc_id", "toxic")
    model = fit_toxicity(corpus, labels, share("doc_id", 3) != 1)
    rows = score_toxicity(corpus, model).join(labels, "doc_id").filter(share("doc_id", 3) == 1).collect()
    right = [r.predicted == r.toxic for r in rows]
    assert len(rows) > 100 and np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    kept = without_toxic(corpus, model)
    assert kept.columns == corpus.columns and kept.filter("toxic = 1").count() < 10 and kept.count() > 460


def test_rare_toxic_words_are_learnt(spark):
    """Each of 150 words in under 1 % of the toxic texts; a passage that 60 of them share is no term; swapped letters."""
    rng = np.random.default_rng(8)
    rare = ["".join(rng.choice(list("gjkqvwxz"), 7)) for _ in range(150)]
    passage = " ".join("".join(rng.choice(list("aeioulmn"), 9)) for _ in range(40))
    rows = []
    for i in range(6000):
        words, bad = sentence(rng, "xx", 30).split(), i % 4 == 0
        if bad:
            words.insert(int(rng.integers(0, 30)), rare[(i // 4) % 150])
        rows.append((i, " ".join(words) + (f" {passage}" if bad and i % 100 == 0 else ""), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs.select("doc_id", "toxic"), F.lit(True))
    hit = [bool(model.hits([w])) for w in rare]
    assert np.mean(hit) > 0.95
    assert not any(model.terms.get(w[:k]) for w in passage.split() for k in range(4, 10))
    swapped = ToxicityModel({"idiot": (6.0, True), "moron": (6.0, True), "scum": (6.0, True)})
    assert all(swapped.hits([w]) for w in ("idoit", "mroon", "scvm", "scmu")) and not swapped.hits(["idtoi"])


def test_toxicity_odd_rows(spark, corpus):
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, ""), (2, "worthless " * 5000)], "doc_id long, text string")
    labels = corpus.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int"))
    model = fit_toxicity(corpus, labels, F.lit(True))
    got = score_toxicity(odd, model).collect()
    assert len(got) == 4 and [r.predicted for r in got if r.doc_id == 2] == [1]
    assert all(0 <= r.score <= 1 and r.score < 0.7 for r in got if r.doc_id != 2)
    for empty in (labels.limit(0), labels.filter("toxic = 0")):
        none = fit_toxicity(corpus, empty, F.lit(True))
        assert score_toxicity(odd, none).filter("score != 0").count() == 0
    assert score_toxicity(odd.limit(0), model).count() == 0


def test_language_held_out(spark, corpus):
    model = fit_languages(corpus, share("doc_id", 4) != 2)
    rows = identify(corpus, model).join(corpus.select("doc_id", "lang"), "doc_id").filter(share("doc_id", 4) == 2).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.99
    odd = [(1, None, None), (2, "", "xx"), (3, "12 ... 4", "xx"), (4, "Ω" * 50000, "xx"), (None, "keit schüber", None), (5, "批准 这个 文本", "xx")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[None].lang_pred == "yy" and not got[None].rejected and got[5].rejected and got[4].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [r.doc_id for r in known_language(docs, model).collect()] == [None]
    assert known_language(corpus, model).count() == corpus.count()
    nothing = fit_languages(corpus.limit(0), F.lit(True))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}


def test_unknown_scripts_are_rejected_at_any_length(spark):
    rng = np.random.default_rng(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**7, "Ok", "en"), (10**7 + 1, "αβγ δεζ ηθι", "en")], "doc_id long, text string, lang string")
    model = fit_languages(docs.select("doc_id", "text", "lang").unionByName(odd), share("doc_id", 4) != 2)
    scripts = {"greek": range(0x3B1, 0x3CA), "cyrillic": range(0x430, 0x450), "cjk": range(0x4E00, 0x5E00), "arabic": range(0x627, 0x64B)}
    rows = []
    for points in scripts.values():
        for n in (10, 50, 200, 1000, 5000):
            words = ["".join(map(chr, rng.choice(points, rng.integers(2, 9)))) for _ in range(n)]
            rows.append((len(rows), " ".join(words)))
    foreign = identify(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert foreign.count() == 20 and foreign.filter("not rejected").count() == 0
    assert known_language(docs, model).count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()


def test_exchange_reaches_a_local_best():
    rng = np.random.default_rng(3)
    true = np.repeat(np.arange(3), 4)
    rates = np.array([[1, 30, 1], [1, 1, 30], [30, 1, 1]])
    bigrams = rng.poisson(rates[true][:, true])
    classes = exchange(bigrams, 3, 20)
    best = class_likelihood(bigrams, classes, 3)
    for unit, other in itertools.product(range(12), range(3)):
        moved = classes.copy()
        moved[unit] = other
        assert class_likelihood(bigrams, moved, 3) <= best + 1e-6
    assert len({tuple(classes[true == t]) for t in range(3)}) == 3 and all(len(set(classes[true == t])) == 1 for t in range(3))


def test_class_model(spark, corpus):
    odd = spark.createDataFrame([(1000, None), (1001, "ONLY Unseen wörds"), (None, ""), (1002, "a\x0bb\x1cc " * 3000)], "doc_id long, text string")
    docs = corpus.select("doc_id", "text").union(odd)
    learn = share("doc_id", 5) != 1
    model = fit_class_model(docs, learn, k=6)
    rows = docs.select("doc_id", "text", share("doc_id", 5).alias("m")).collect()
    counts, ends = Counter(), 0
    for r in rows:
        if r.m != 1:
            counts.update(words_of(r.text or ""))
            ends += 1
    n, size = sum(counts.values()) + ends, 0
    size = n + 0.5 * (len(counts) + 2)
    got = {r.doc_id: r for r in score_texts(docs, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = words_of(r.text or "")
        base = sum(math.log10((counts[w] + 0.5) / size) for w in words) + math.log10((ends + 0.5) / size)
        g = got[r.doc_id]
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.train_tokens == n
        assert (g.n_tokens, g.n_known) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1)
    held = [got[r.doc_id] for r in rows if r.m == 1 and r.doc_id and r.doc_id < 1000]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
    # what the model gives all words after an end: known ones, and one unseen word of each kind
    units = model.units
    first = model.log_step[model.classes[0]]
    total = 0.0
    for u in range(units.size):
        p = 10 ** (first[model.classes[u]] + model.log_unit[u])
        if u < units.first_kind:
            total += p
        else:
            kind = u - units.first_kind
            from weftlink.llm.class_lm import kind_of
            inside = [c + 0.5 for w, c in counts.items() if w not in units.number and kind_of(w) == kind]
            total += p * (sum(inside) + 0.5) / model.kind_size[kind]
    assert total == pytest.approx(1.0, abs=1e-9)


def test_class_model_joins_what_is_not_sent(spark, corpus, monkeypatch):
    import weftlink.llm.class_lm as lm

    learn = share("doc_id", 5) != 1
    whole = {r.doc_id: r for r in score_texts(corpus, fit_class_model(corpus, learn, k=4)).collect()}
    monkeypatch.setattr(lm, "UNIT_WORDS", 20)
    few = {r.doc_id: r for r in score_texts(corpus, lm.fit_class_model(corpus, learn, k=4)).collect()}
    monkeypatch.setattr(lm, "SENT_WORDS", 25)
    joined = {r.doc_id: r for r in score_texts(corpus, lm.fit_class_model(corpus, learn, k=4)).collect()}
    for key, r in whole.items():
        assert joined[key].base_score == pytest.approx(r.base_score) and joined[key].n_known == r.n_known
        assert joined[key].score == pytest.approx(few[key].score)
    empty = lm.fit_class_model(corpus.limit(0), learn)
    got = score_texts(corpus.limit(2), empty).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert score_texts(corpus.limit(0), empty).count() == 0
