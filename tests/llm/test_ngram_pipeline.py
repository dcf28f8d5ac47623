"""The n-gram join against brute force over all pairs, and the pipeline's stages."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from weftlink.plans.components import components
from weftlink.llm.ngram_join import band_count, one_of_each_class, shared_counts, similarity_classes

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [grams(t) for _, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            best[find(i)] = min(best.get(find(i), key), key)
    return Counter((key, best.get(find(i)) if sets[i] else key, links[i]) for i, (key, _) in enumerate(rows))


def texts(seed=1):
    rng = np.random.default_rng(seed)
    word = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for n in (1, 3, 6, 40, 120, 300):
        for _ in range(4):
            base = list(rng.choice(word, n))
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                new = list(base)
                for at in rng.integers(0, n, edits):
                    new[at] = str(rng.choice(word))
                rows.append((key, " ".join(new)))
                key += 1
    return rows + [(key, None), (key + 1, ""), (key + 2, " \n\t"), (key + 3, "W1 w2"), (key + 4, "w1\nW2 ")]


def got(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_classes_equal_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", class_id int, set_id string").repartition(4)
    assert got(similarity_classes(docs)) == brute(rows)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    import weftlink.llm.ngram_join as join

    monkeypatch.setattr(join, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for key in range(90):
        new = list(base)
        for at in rng.integers(0, 200, 4):
            new[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((key, " ".join(new)))
    rows += [(100 + i, " ".join(base)) for i in range(40)]
    assert got(similarity_classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_keys(spark):
    text = "one two three four five six"
    rows = [(None, text), (None, text), (5, text), (5, text), (None, "other words here that stand alone now"), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(similarity_classes(docs)) == brute(rows)
    kept = one_of_each_class(docs).collect()
    assert sorted((r.text or "") for r in kept) == sorted(["", text, "other words here that stand alone now"])
    assert similarity_classes(docs.limit(0)).count() == 0 and one_of_each_class(docs.limit(0)).count() == 0
    assert similarity_classes(docs.filter("text is null")).count() == 1


def test_band_count_meets_recall():
    for s in (0.5, 0.8, 0.9):
        b = band_count(s)
        assert 1 - (1 - s**6) ** b >= 0.999 > 1 - (1 - s**6) ** (b - 1)


def test_shared_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.int64) for n in rng.integers(1, 40, 12)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]
    assert shared_counts(sets[:5], sets[5:]).tolist() == want


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.root for r in rows} == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        path = spark.createDataFrame(out.collect(), docs.schema)  # as rows of their own, not the plan
        kept = {r.doc_id for r in path.collect()}
        if name == "toxicity":
            gone = set(left) - kept
            assert all(labels.get(k, 1) == 1 for k in gone)
        if name == "language":
            assert kept == {k for k, t in left.items() if t and any(map(str.isalpha, t))}
        if name == "near_copies":
            classes = {}
            for key, of, _ in brute(list(left.items())):
                classes.setdefault(of, set()).add(key)
            assert all(len(kept & members) == 1 for members in classes.values())
        docs, left = path, {k: t for k, t in left.items() if k in kept}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(left)
    room = Counter()
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "best_fit_packing"]
    result = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(result.columns) and result.count() > 100


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0


def test_pipeline_batches_are_small_and_the_setting_comes_back(spark):
    """The jobs of a stage get few rows at a time, also where the stage fails; a smaller setting stays."""
    import pyarrow as pa

    from weftlink.session import cut_lineage, small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long")
    try:
        with small_batches(spark, 1000):
            got = cut_lineage(rows)
            raise KeyError("a stage fails")
    except KeyError:
        assert spark.conf.get(name) == before
    assert [r.n for r in got.collect()] == [1000] * 5
    spark.conf.set(name, 300)
    try:
        with small_batches(spark, 1000):
            assert spark.conf.get(name) == "300"
    finally:
        spark.conf.set(name, before)
