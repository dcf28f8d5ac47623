import collections
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlink.operators import cosine as C
from weftlink.operators import jaccard as J
from weftlink.operators.checks import require_complete, stale_rows_dropped
from weftlink.operators.cluster import leaf_order
from weftlink.operators.figures import cell_style, curve_points, even_places, group_boundaries
from weftlink.operators.links import combine, linked_pairs, pair_heatmap, pair_heatmap_combined
from weftlink.operators.midrank import add_percentile, histogram_of, midrank_table, with_zeros
from weftlink.plans.ordering import with_dense_position, with_position


def vectors(n=90, width=5, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, width))
    m[7] = m[8]  # a copy
    m[9] = 0.0
    return [(f"d{i:03d}", "ABC"[i % 3], [float(x) for x in row]) for i, row in enumerate(m)]


def sims(rows):
    m = np.array([r[2] for r in rows])
    n = np.linalg.norm(m, axis=1)
    n[n == 0] = 1
    u = m / n[:, None]
    return np.round(u @ u.T, 6)


@pytest.fixture(scope="module")
def rows():
    return vectors()


@pytest.fixture(scope="module")
def defs(spark, rows):
    return spark.createDataFrame(rows, "id string, keyset string, embedding array<double>")


def test_cosine_edges_in_small_tiles(defs, rows):
    got = {(r.id_a, r.id_b): r.sim for r in C.cosine_edges(defs, 6, block_rows=16).collect()}
    s = sims(rows)
    want = {(a[0], b[0]): s[i, j] for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1.5e-6 for k in want)
    assert all(got[a, b] == got[b, a] for a, b in got)


def test_cosine_reductions(defs, rows):
    edges = C.cosine_edges(defs, 6)
    want = {(r.id_a, r.keyset_b): r for r in edges.groupBy("id_a", "keyset_b").agg(F.count("*").alias("n"), F.sum("sim").alias("s"), F.max("sim").alias("m")).collect()}
    for r in C.cosine_profile(defs, 6, block_rows=16).collect():
        w = want[r.id_a, r.keyset_b]
        assert r.n_edges == w.n and abs(r.sum_sim - w.s) < 1e-4 and abs(r.max_sim - w.m) < 1.5e-6
    assert C.cosine_histogram(defs, 6, block_rows=16).agg(F.sum("n")).first()[0] == 90 * 89
    assert C.cosine_histogram(defs, 7, block_rows=16).agg(F.sum("n")).first()[0] == 90 * 89
    with pytest.raises(ValueError, match="would list the pairs"):
        C.cosine_histogram(defs, 9)
    matrix = {(r.keyset_a, r.keyset_b): r.mean_value for r in C.cosine_keyset_matrix(defs).collect()}
    for r in edges.groupBy("keyset_a", "keyset_b").agg(F.avg("sim").alias("m")).collect():
        assert abs(matrix[r.keyset_a, r.keyset_b] - r.m) < 1e-5
    top = {(r.id_a, r.keyset_b, r.link_rank): r.id_b for r in C.cosine_top_links(defs, 4, 6, block_rows=16).collect()}
    exact = {
        (r.id_a, r.keyset_b, r.link_rank): r.id_b for r in C.best_links(edges.filter("sim > 0"), "sim", 4).collect()
    }
    assert top == exact
    assert all(r.sim <= 1 for r in C.cosine_profile(defs, 12, self_pairs=True).selectExpr("max_sim as sim").collect())


def cites(spark, n=60, seed=5):
    """A third of the definitions cite the same set, another third share one work."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        works = {1, 2, 3} if i % 3 == 0 else {rng.randint(10, 40) for _ in range(rng.randint(1, 6))} | ({99} if i % 3 == 1 else set())
        out += [(f"d{i:03d}", "ABC"[i % 4 % 3], w) for w in works]
    out += out[:20] + [("d000", "A", None)]
    return spark.createDataFrame(out, "id string, keyset string, work int"), out


def brute_jaccard(out):
    sets, keysets = defaultdict(set), {}
    for i, k, w in out:
        if w is not None:
            sets[i].add(w)
            keysets[i] = k
    return {
        (a, b): (len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b]))
        for a in sets for b in sets if a != b and sets[a] & sets[b]
    }, keysets


def test_no_pair_leaves_the_task_that_counts_it(spark):
    # all share one work: every pair overlaps, and all values but a definition's own tie
    cites = spark.createDataFrame(
        [(f"d{i:02}", "AB"[i % 2], w) for i in range(60) for w in ("hub", f"own{i}")], "id string, keyset string, work string"
    )
    sets = J.cited_sets(cites, 7)
    found = J.overlap_answers(sets, top_n=1, decimals=6)
    assert found.filter("kind = 0").count() <= 60 * 5 and found.filter("kind = 2").count() <= 2 * 60
    links = {(r.id_a, r.keyset_b): (r.id_b, r.n_shared, r.jaccard) for r in J.jaccard_top_links(sets, 1, found).collect()}
    assert len(links) == 120
    for (a, k), got in links.items():
        first = next(f"d{i:02}" for i in range(60) if "AB"[i % 2] == k and f"d{i:02}" != a)
        assert got == (first, 1, 1 / 3)
    assert {r.bin: r.n for r in J.jaccard_histogram(sets, 60, 6, found).collect() if r.n} == {333333: 60 * 59}


def test_overlaps_are_counted_whole_across_batches(monkeypatch):
    monkeypatch.setattr(J, "LAID_OUT", 3)
    runs = J.ClassRuns(np.array([0]), np.array([4]), np.array([1]), np.array([0]), ["k"])
    rows = [(c, list(others), asked) for c in range(5) for others, asked in [([c, 4], False), ([c, 3, 4], False), ([4], True)]]
    schema = pa.schema([("class", pa.int32()), ("others", pa.list_(pa.int32())), ("asked", pa.bool_())])
    batches = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 2]), schema)], schema=schema) for i in range(0, 15, 2)]
    got, asked = {}, []
    for p in J._counted(iter(batches), runs):
        for a, b, n in zip(p.a.tolist(), p.b.tolist(), p.shared.tolist()):
            assert (a, b) not in got
            got[a, b] = n
        asked += [(int(p.a[i]), int(p.b[i])) for i in p.asked]
    want = collections.Counter((c, o) for c, others, a in rows if not a for o in others)
    assert got == dict(want) and sorted(asked) == [(c, 4) for c in range(5)]


@pytest.mark.parametrize("chunk", [2000, 4])
def test_jaccard_against_all_pairs(spark, chunk):
    df, out = cites(spark)
    want, keysets = brute_jaccard(out)
    got = {(r.id_a, r.id_b): (r.n_shared, r.jaccard) for r in J.jaccard_edges(df, chunk).collect()}
    assert got == want
    sets = J.cited_sets(df, chunk)
    for r in J.jaccard_profile(sets).collect():
        mine = [v for (a, _), v in want.items() if a == r.id_a]
        assert r.n_edges == len(mine) and r.sum_shared == sum(s for s, _ in mine)
        assert abs(r.sum_jaccard - sum(j for _, j in mine)) < 1e-9 and r.max_jaccard == max(j for _, j in mine)
    ranked = defaultdict(list)
    for (a, b), (_, j) in want.items():
        ranked[a, keysets[b]].append((-j, b))
    links = defaultdict(list)
    for r in J.jaccard_top_links(sets, 2).orderBy("link_rank").collect():
        links[r.id_a, r.keyset_b].append((-r.jaccard, r.id_b))
    assert links == {k: sorted(v)[:2] for k, v in ranked.items()}
    n = len(keysets) + 5
    bins = {r.bin: r.n for r in J.jaccard_histogram(sets, n, 6).collect()}
    assert sum(bins.values()) == n * (n - 1) and bins[0] == n * (n - 1) - len(want)
    definitions = spark.createDataFrame([(i, k) for i, k in keysets.items()] + [("lonely", "Z")], "id string, keyset string")
    matrix = {(r.keyset_a, r.keyset_b): r.mean_value for r in J.jaccard_keyset_matrix(sets, definitions).collect()}
    size = definitions.groupBy("keyset").count().rdd.collectAsMap()
    for (a, b), mean in matrix.items():
        total = sum(j for (x, y), (_, j) in want.items() if keysets[x] == a and keysets[y] == b)
        assert abs(mean - total / (size[a] * size[b] - (size[a] if a == b else 0))) < 1e-9
    assert matrix["Z", "A"] == 0 and ("Z", "Z") not in matrix


def test_midrank_example(spark):
    values = [0, 0, 0, 0.1, 0.2, 0.2, 0.5, 0.9]
    df = spark.createDataFrame([(float(v),) for v in values if v], "v double")
    table = midrank_table(with_zeros(histogram_of(df, "v", 12), len(values)), 12)
    assert [(r.bin / 1e12, r.percentile) for r in table.orderBy("bin").collect()] == [
        (0.0, 0.1875), (0.1, 0.4375), (0.2, 0.625), (0.5, 0.8125), (0.9, 0.9375),
    ]


def meta_of(defs):
    none = F.lit(None).cast("string")
    return defs.select("id", "keyset", F.concat(F.lit("T "), "id").alias("title"), none.alias("code"), none.alias("short_name"))


def ids_of(defs, keyset):
    return defs.filter(f"keyset = '{keyset}'").select("id")


def test_heatmap_keeps_unlinked_definitions(spark, defs):
    df, out = cites(spark)
    edges1, edges2 = C.cosine_edges(defs), J.jaccard_edges(df)
    cells = pair_heatmap_combined(edges1, edges2, meta_of(defs), ids_of(defs, "A"), ids_of(defs, "B")).collect()
    assert len(cells) == 30 * 30
    want, _ = brute_jaccard(out)
    background = [j for _, j in want.values()] + [0.0] * (90 * 89 - len(want))
    for c in cells[::7]:
        v = want.get((c.id_a, c.id_b), (0, 0.0))[1]
        rank = (sum(b < v for b in background) + 0.5 * sum(b == v for b in background)) / len(background)
        assert abs(c.percentile_stage2 - rank) < 1e-12
        assert c.combined == (c.percentile_stage1 + c.percentile_stage2) / 2
        assert c.n_agree == c.real_diff_stage1 + c.real_diff_stage2
    a = ids_of(defs, "A")
    same = pair_heatmap(edges1, meta_of(defs), "sim", a, a).collect()
    assert len(same) == 900 and all(r.percentile is not None for r in same)


def test_every_value_has_a_rank(spark):
    background = spark.createDataFrame([(-2, 3), (0, 4), (5, 1)], "bin long, n long")
    asked = spark.createDataFrame([(v / 10,) for v in (-3, -2, -1, 0, 3, 5, 9)], "v double")
    got = {round(r.v * 10): r.percentile for r in add_percentile(asked, "v", background, 1).collect()}
    assert got == {-3: 0.0, -2: 1.5 / 8, -1: 3 / 8, 0: 5 / 8, 3: 7 / 8, 5: 7.5 / 8, 9: 1.0}


def test_linked_pairs_agree_with_the_grid(spark, defs):
    df, _ = cites(spark)
    links = linked_pairs(defs, df, 2, decimals=12).filter("keyset_a = 'A' and keyset_b = 'B'").collect()
    cells = {(c.id_a, c.id_b): c for c in pair_heatmap_combined(C.cosine_edges(defs), J.jaccard_edges(df), meta_of(defs), ids_of(defs, "A"), ids_of(defs, "B")).collect()}
    assert links
    for r in links:
        c = cells[r.id_a, r.id_b]
        assert (r.jaccard, r.percentile_stage2, r.n_agree) == (c.jaccard, c.percentile_stage2, c.n_agree)
        assert abs(r.percentile_stage1 - c.percentile_stage1) < 1e-9


def brute_order(rows):
    """Average linkage over all pairs, closest first; the tighter side goes left."""
    m = np.array([r[2] for r in rows])
    n = np.linalg.norm(m, axis=1)
    n[n == 0] = 1
    s = (m / n[:, None]) @ (m / n[:, None]).T
    clusters = {r[0]: ([i], 0.0, r[0]) for i, r in enumerate(rows)}
    while len(clusters) > 1:
        names = sorted(clusters)
        best = max(
            ((round(s[np.ix_(clusters[a][0], clusters[b][0])].mean(), 12), a, b) for x, a in enumerate(names) for b in names[x + 1:]),
            key=lambda t: t[0],
        )
        c, a, b = best
        left, right = sorted((clusters.pop(a), clusters.pop(b)), key=lambda k: (k[1], k[2]))
        clusters[min(a, b)] = (left[0] + right[0], 1 - c, min(left[2], right[2]))
    return [rows[i][0] for i in next(iter(clusters.values()))[0]]


def test_leaf_order_in_rounds(spark):
    rows = [r for i, r in enumerate(vectors(40, 6, 11)) if i != 9]
    df = spark.createDataFrame(rows, "id string, keyset string, embedding array<double>")
    want = brute_order(rows)
    for finish_at in (100, 15):
        got = [r.id for r in leaf_order(df, finish_at, block_rows=16).orderBy("position").collect()]
        assert got == want


def test_leaf_order_asks_again_only_where_a_nearest_cluster_merged(spark, monkeypatch):
    from weftlink.operators import cluster

    rows = [r for i, r in enumerate(vectors(70, 6, 12)) if i != 9]
    df = spark.createDataFrame(rows, "id string, keyset string, embedding array<double>")
    asked, plain = [], cluster.nearest
    monkeypatch.setattr(cluster, "nearest", lambda some, every, n_some, n, *rest: asked.append((n_some, n)) or plain(some, every, n_some, n, *rest))
    want = brute_order(rows)
    for local_at in (69, 40):
        got = [r.id for r in leaf_order(df, 15, 16, local_at).orderBy("position").collect()]
        assert got == want
    assert asked[0] == (69, 69) and len(asked) > 1 and all(some < every for some, every in asked[1:])


def test_best_links_of_a_block_while_targets_pass(rows):
    from weftlink.plans.tiles import stripe_counts

    # a target is copied once a block, so copies stay few where tiles of 1024 rows made 601 of each
    assert stripe_counts(615_384, 615_384, 16384, 12) == (48, 1)
    table = pa.table({"id": [r[0] for r in rows], "keyset": [r[1] for r in rows], "embedding": [r[2] for r in rows]})
    best = C._Best(table.slice(0, 30), 4, 6)
    for start in (60, 0, 30):
        best.meet(table.slice(start, 30))
        best.sort()
    found, s, got = best.take(), sims(rows), collections.defaultdict(list)
    for source, name, sim, other in zip(*(found.column(c).to_pylist() for c in ("source", "keyset", "sim", "id"))):
        got[source, list(best.names)[name]].append((-sim, other))
    for i in range(30):
        for name in "ABC":
            want = sorted((-s[i, j], r[0]) for j, r in enumerate(rows) if r[1] == name and j != i and s[i, j] > 0)[:4]
            assert np.allclose([w[0] for w in want], [g[0] for g in got[i, name]]) and [w[1] for w in want] == [g[1] for g in got[i, name]]


def test_checks(spark, defs):
    part = defs.filter("id < 'd050'")
    assert stale_rows_dropped(defs, part).count() == 50
    with pytest.raises(ValueError, match="40 id"):
        require_complete(defs, part)


def test_positions_and_curves(spark):
    df = spark.createDataFrame([(n, g) for n, g in zip("dacbe", "yxyxy")], "name string, grp string")
    placed = with_position(df, ["name"], "p")
    assert [r.p for r in placed.orderBy("name").collect()] == [1, 2, 3, 4, 5]
    assert [(r.group_before, r.line_at) for r in group_boundaries(placed, "p", "grp").collect()] == [("x", 2.5)]
    ys = [r.y for r in even_places(df, ["name"]).orderBy("name").collect()]
    assert np.allclose(ys, [0.98, 0.74, 0.5, 0.26, 0.02])
    assert [r.y for r in even_places(df.limit(1), ["name"]).collect()] == [0.5]
    mixed = spark.createDataFrame([(x,) for x in "bBaz"], "x string")
    assert [r.x for r in with_dense_position(mixed, "x", "p", collation="UNICODE").orderBy("p").collect()] == ["a", "b", "B", "z"]
    link = spark.createDataFrame([(0.0, 1.0, 0.0, 2.0)], "x0 double, x1 double, y0 double, y1 double")
    points = curve_points(link).orderBy("point").collect()
    assert len(points) == 40 and points[0].y == 0 and points[-1].y == 2 and points[-1].x == 1


# percentile, cosine, Jaccard x 10, flags of the published figure's marked cells and two plain ones
PUBLISHED = [
    ("4.4", 0.95, 0.79, 0.00, True, False, "dashed"),
    ("5.1", 0.97, 0.79, 0.87, True, True, "solid"),
    ("5.4", 0.99, 0.81, 0.75, True, True, "solid"),
    ("5.5", 1.00, 0.85, 0.18, True, False, "dashed"),
    ("3.1", 0.52, 0.69, 0.43, False, True, "dashed"),
    ("2.3", 0.00, 0.49, 0.00, False, False, "none"),
    ("1.1", 0.37, 0.67, 0.16, False, False, "none"),
]


def test_published_cells(spark):
    cells = spark.createDataFrame(
        [(n, p, s, j / 10, f1, f2, 0.5) for n, p, s, j, f1, f2, _ in PUBLISHED],
        "name string, percentile_stage1 double, sim double, jaccard double, real_diff_stage1 boolean,"
        " real_diff_stage2 boolean, percentile_stage2 double",
    )
    styled = {r.name: r for r in cell_style(combine(cells)).collect()}
    for name, p, s, j, f1, f2, border in PUBLISHED:
        r = styled[name]
        assert r.border == border and r.face_stage1 == ("bold" if f1 else "plain")
        assert (r.text_percentile, r.text_sim, r.text_jaccard) == (f"{p:.2f}", f"{s:.2f}", f"{j:.2f}")
    assert styled["5.5"].fill == "#B2182B" and styled["2.3"].fill == "#2166AC" and styled["2.3"].text_color == "white"


def test_top_places_keep_ties_in_column_order():
    """The highest positive values of each row, as a stable sort of the whole row picks them."""
    import numpy as np

    from weftlink.operators.cosine import _top_places

    rng = np.random.default_rng(5)
    for width in (1, 3, 4, 40):
        values = rng.integers(-4, 5, (30, width)) / 4
        values[rng.random(values.shape) < 0.1] = rng.choice([np.nan, -np.inf, np.inf])
        values[0], values[1] = 1.0, np.nan
        want = []
        for i, row in enumerate(values):
            fit = np.where((row > 0) & (row < np.inf), row, -np.inf)
            want += [(i, j) for j in np.argsort(-fit, kind="stable")[:3].tolist() if fit[j] > 0]
        assert list(zip(*(x.tolist() for x in _top_places(values, 3)), strict=True)) == want


def test_profile_and_histogram_in_blocks(defs, rows, monkeypatch):
    """Blocks and slices of any size give the same numbers, also when a task passes on what it holds."""
    whole = {(r.id_a, r.keyset_b): r for r in C.cosine_profile(defs, 6).collect()}
    bins = {r.bin: r.n for r in C.cosine_histogram(defs, 6).collect()}
    monkeypatch.setattr(C, "ROOM", 64)
    monkeypatch.setattr(C, "MOST_HELD", 100)
    monkeypatch.setattr(C, "SLICE", 7)
    names = sorted({r[1] for r in rows})
    table = pa.table({"id": [r[0] for r in rows], "keyset": [r[1] for r in rows], "embedding": [r[2] for r in rows]})
    for self_pairs in (False, True):
        profile = C._Profile(table, 6, self_pairs)
        batches = [b for part in table.to_batches(40) for b in profile.meet(pa.Table.from_batches([part]))] + [*profile.take()]
        got = pa.Table.from_batches(batches).group_by(["id_a", "keyset_b"]).aggregate([("n", "sum"), ("total", "sum"), ("low", "min"), ("high", "max")])
        assert got.num_rows == len(rows) * len(names)
        if not self_pairs:
            for r in got.to_pylist():
                w = whole[r["id_a"], r["keyset_b"]]
                assert (r["n_sum"], r["low_min"], r["high_max"]) == (w.n_edges, w.min_sim, w.max_sim)
                assert abs(r["total_sum"] - w.sum_sim) < 1e-9
    assert {r.bin: r.n for r in C.cosine_histogram(defs, 6, block_rows=16).collect()} == bins


def test_few_copies_of_large_tables():
    from weftlink.plans.tiles import block_count, roomy_block, stripe_counts

    # 600,000 vectors of 64 numbers on 8 cores: a vector is copied to some ten tiles, not to hundreds
    assert block_count(600_000, roomy_block(600_000, 64, 8), 8) <= 10
    assert sum(stripe_counts(600_000, 600_000, 65536, 8, small_answers=True)) <= 14
    assert roomy_block(600_000, 768, 8) == (1 << 22) // 768


def test_cosine_of_pairs_carries_no_vectors(spark, defs, rows):
    """Repeated ids multiply, unknown ones drop out, and a missing vector has no similarity; other columns stay."""
    from pyspark.sql import functions as F

    from weftlink.operators.cosine import cosine_of_pairs

    want = sims(rows)
    odd = spark.createDataFrame([("twice", "k", [1.0, 0.0, 0.0, 0.0, 0.0])] * 2 + [("none", "k", None), ("short", "k", [1.0]), (None, "k", [1.0])], defs.schema)
    every = defs.unionByName(odd)
    a, b = rows[0][0], rows[1][0]
    asked = [(a, b, 1), (b, a, 2), (a, "twice", 3), ("twice", "twice", 4), (a, "none", 5), (a, "short", 6), ("gone", a, 7), (None, a, 8)]
    pairs = spark.createDataFrame(asked, "id_a string, id_b string, tag int")
    out = cosine_of_pairs(pairs, every, 6)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in out.select("tag", "sim").orderBy("tag").collect()]
    assert [t for t, _ in got] == [1, 2, 3, 3, 4, 4, 4, 4, 5, 6]
    found = {t: s for t, s in got}
    assert abs(found[1] - want[0, 1]) < 1e-6 and found[1] == found[2] and found[4] == 1.0 and found[5] is None and found[6] is None


def test_ranked_grid_joins_no_cells(spark, defs):
    """Cells are made where their vectors and overlaps meet; blocks of any size give the same cells."""
    from weftlink.operators import links as L

    made = []
    cut = L.cut_lineage
    try:
        L.cut_lineage = lambda df: made.append(cut(df)) or made[-1]
        grids = []
        for block, cells in ((2048, 1 << 18), (64, 100)):
            L.RANKED_BLOCK, L.CELLS = block, cells
            grid = L.grid_percentiles(defs, cites(spark)[0], meta_of(defs), defs.select("id"), defs.select("id"))
            grids.append(sorted(tuple(r) for r in grid.collect()))
    finally:
        L.cut_lineage, L.RANKED_BLOCK, L.CELLS = cut, 2048, 1 << 18
    assert len(grids[0]) == 90 * 90 and grids[0] == grids[1]
    assert max(df.count() for df in made) == 90  # the sides are stored, no cells
