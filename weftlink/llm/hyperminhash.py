"""Near-duplicate classes by HyperMinHash: banded registers, estimates corrected for collisions, full sets at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import mix64, slices
from weftlink.llm.ngram_join import band_count, byte_gram_sets, set_ids
from weftlink.plans.components import components
from weftlink.session import cut_lineage

#: Five-word shingles; a pair is linked if 100 times its common shingles are at least so many times its shingles.
WORDS, PERCENT = 5, 85
#: Buckets of a sketch: the first bits of a hash choose one.
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
#: Mantissa bits that a register keeps after the leading one.
MANTISSA = 10
#: Registers in a band, and the chance that a pair of just the asked similarity shares a band.
BAND_ROWS, RECALL = 6, 0.99999
#: Estimates this many standard errors under the asked similarity are not verified.
ERRORS = 6.0
#: Sets of one block; a tile compares two blocks.
BLOCK = 256
SLICE_BYTES = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Where an empty bucket looks for a register to borrow: each bucket has its own order of all buckets.
_WALK = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1)


def sketches(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of the sets that are not empty: leading zeros and mantissa of each bucket's least hash.

    A set's hashes ascend, so a bucket's hashes stand together and the first of them is its least. An empty bucket
    holds 0; a register is (leading zeros + 1) * 2**MANTISSA + mantissa, whose order does not matter here.
    """
    some = sizes[sizes > 0]
    row = np.repeat(np.arange(len(some)), some)
    bucket = (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    place = row * BUCKETS + bucket
    first = np.flatnonzero(np.diff(place, prepend=-1))
    rest = grams[first] << np.uint64(BUCKET_BITS)  # the bits after those of the bucket, to the left
    # the exponent of the upper 52 bits, which a float holds exactly, gives the leading zeros
    zeros = 52 - np.frexp((rest >> np.uint64(12)).astype(np.float64))[1].astype(np.int64)
    zeros = np.minimum(zeros, 52)
    after = (rest << zeros.astype(np.uint64)) << np.uint64(1)
    out = np.zeros(len(some) * BUCKETS, dtype=np.uint16)
    out[place[first]] = ((zeros + 1) << MANTISSA) | (after >> np.uint64(64 - MANTISSA)).astype(np.int64)
    return out.reshape(-1, BUCKETS)


def densified(registers: np.ndarray) -> np.ndarray:
    """Registers without empty buckets: each borrows from the first filled one on its own walk, alike for all sets."""
    out = registers.copy()
    row, column = np.nonzero(registers == 0)
    for step in range(BUCKETS):
        if not len(row):
            break
        found = registers[row, _WALK[column, step]]
        out[row, column] = found
        row, column = row[found == 0], column[found == 0]
    return out


def band_keys(registers: np.ndarray, bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """A hash of each band's registers, with the band's number in it."""
    dense = densified(registers).astype(np.uint64)
    # the registers of a band are drawn from all over the sketch, each register for about the same number of bands
    order = np.concatenate([np.random.default_rng(band).permutation(BUCKETS) for band in range(-(-bands * rows // BUCKETS))])
    out = np.empty((len(registers), bands), dtype=np.uint64)
    for band in range(bands):
        mixed = np.full(len(registers), np.uint64(band + 1))
        for at in order[band * rows : (band + 1) * rows]:
            mixed = mix64(mixed * _STEP + dense[:, at])
        out[:, band] = mixed
    return out


@lru_cache(maxsize=4096)
def chance_collision(n: float, m: float) -> float:
    """The chance that a bucket's registers agree in two sets of ``n`` and ``m`` members that have none in common.

    A register stands for an interval of hashes; a set of n members has its least hash there with the chance
    (1 - a)^n - (1 - b)^n, a and b being the ends of the interval in the bucket, as a share of all hashes.
    """
    top = 2.0 ** -np.arange(1, 40)  # the interval of z leading zeros begins at 2^-(z+1)
    ends = top[:, None] * (1 + np.arange((1 << MANTISSA) + 1) / (1 << MANTISSA))[None, :] / BUCKETS
    low, high = ends[:, :-1], ends[:, 1:]

    def share(k: float) -> np.ndarray:
        return np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-high))

    return float((share(n) * share(m)).sum())


def _rounded(n: float) -> float:
    """Sizes to about 6%, so that chances are worked out once for many pairs."""
    return 2.0 ** (round(math.log2(max(n, 1)) * 12) / 12)


def estimates(registers: np.ndarray, others: np.ndarray, sizes: np.ndarray, other_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities of all pairs as the sketches tell them, and the number of buckets they rest on.

    Equal registers over filled buckets, less the agreements that chance alone makes in the buckets that differ.
    """
    same = np.zeros((len(registers), len(others)), dtype=np.int32)
    either = np.zeros_like(same)
    for at in range(BUCKETS):
        left, right = registers[:, at], others[:, at]
        filled = (left > 0)[:, None] | (right > 0)[None, :]
        either += filled
        same += (left[:, None] == right[None, :]) & filled
    mine, theirs = [_rounded(n) for n in sizes], [_rounded(n) for n in other_sizes]
    pairs = {(a, b): chance_collision(min(a, b), max(a, b)) for a in set(mine) for b in set(theirs)}
    chance = np.array([[pairs[a, b] for b in theirs] for a in mine]) if len(mine) and len(theirs) else np.zeros(same.shape)
    # of the buckets that share no member, chance makes some agree: same = true + (either - true) * chance
    return np.clip((same - either * chance) / np.maximum(either * (1 - chance), 1e-9), 0, 1), either


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays without repeats share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least ``percent`` times the union."""
    both = common(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    # bytes.lower knows only A-Z
    return [(t or b"").lower() for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _signatures(docs: DataFrame, bands: int, words: int) -> DataFrame:
    """``key, set_id, size, registers, bands`` of ``key, text``; all but key and size null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                grams, sizes = byte_gram_sets(_texts(rows, "text"), words)
                made = sketches(grams, sizes) if len(grams) else np.zeros((0, BUCKETS), dtype=np.uint16)
                registers, keys = iter(made), iter(band_keys(made, bands).view(np.int64))
                some = (sizes > 0).tolist()
                arrays = [
                    rows.column("key"),
                    pa.array(set_ids(grams, sizes), pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array([next(registers).tobytes() if s else None for s in some], pa.binary()),
                    pa.array([next(keys) if s else None for s in some], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "set_id", "size", "registers", "bands"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, set_id binary, size long, registers binary, bands array<long>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``set_id, grams`` of ``text``; the grams of a set ascend as unsigned numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                grams, sizes = byte_gram_sets(_texts(rows, "text"), words)
                ends = np.cumsum(sizes)
                cells = [grams[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(grams, sizes), pa.binary()), pa.array(cells, pa.binary())], names=["set_id", "grams"])

    return docs.mapInArrow(run, "set_id binary, grams binary")


def _numbers(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, dtype=np.uint64)


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The rows ``a, b`` of ``a, b, left, right`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            keep = [linked(_numbers(x), _numbers(y), percent) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def _tile(percent: int):
    """Links between different classes of two blocks: one row a set, with the least set it now hangs together with."""

    def run(rows: pa.Table) -> pa.Table:
        ids, roots = rows["set_id"].to_pylist(), rows["root"].to_pylist()
        block, sizes = rows["block"].to_numpy(), rows["size"].to_numpy().astype(np.float64)
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        regs = np.frombuffer(b"".join(rows["registers"].to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
        sets = [_numbers(g) for g in rows["grams"].to_pylist()]
        parent = {r: r for r in roots}

        def find(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        if len(left) and len(right):
            likely, rest_on = estimates(regs[left], regs[right], sizes[left], sizes[right])
            asked = percent / 100
            error = np.sqrt(asked * (1 - asked) / np.maximum(rest_on, 1))
            small, large = np.minimum(sizes[left][:, None], sizes[right][None, :]), np.maximum(sizes[left][:, None], sizes[right][None, :])
            hopeful = (likely >= asked - ERRORS * error) & (100 * small >= percent * large)
            # the likeliest first: a pair whose classes have met by then need not be looked at
            x, y = np.nonzero(hopeful)
            for at in np.argsort(-likely[x, y], kind="stable").tolist():
                a, b = int(left[x[at]]), int(right[y[at]])
                one, two = find(roots[a]), find(roots[b])
                if one != two and linked(sets[a], sets[b], percent):
                    parent[max(one, two)] = min(one, two)
        moved = [(r, find(r)) for r in parent if find(r) != r]
        return pa.table({"a": pa.array([a for a, _ in moved], pa.binary()), "b": pa.array([b for _, b in moved], pa.binary())})

    return run


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS, block: int = BLOCK
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row: the size of its set of word n-grams, its class, its first row.

    Words are cut at white space (ASCII), A-Z lower-cased. Two rows are linked if 100 times the common n-grams of their
    sets are at least ``percent`` times all; a class is what links connect, its id the smallest key in it, and that
    key's row is kept. A text of fewer words than an n-gram is one n-gram; a null or empty one is linked with nothing.

    Rows with equal sets are one set. Each set is a HyperMinHash sketch; sets that share a band of registers, or are
    tied by others that do, are candidates. Each is first compared on the full sets with the smallest set it shares
    a band with; that joins most of a large group in one row a set. What is left between different classes of one
    group of candidates is compared in blocks: estimates choose the pairs, full sets confirm them, and a pair of one
    class is not looked at. So a block meets only blocks that may hold another class, and no pair leaves a task.

    Null keys are allowed; they name a class only if all its keys are null. Repeated rows are copies. Other columns are
    not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = cut_lineage(_signatures(rows, band_count(percent / 100, BAND_ROWS, RECALL), words))
    some = signed.filter("set_id is not null")
    sets = cut_lineage(
        some.groupBy("set_id").agg(
            F.min("key").alias("first"), *[F.first(c).alias(c) for c in ("size", "registers", "bands")]
        )
    )
    placed = sets.select("set_id", F.explode("bands").alias("h"))
    buckets = placed.groupBy("h").agg(F.min("set_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    near = placed.join(buckets, "h").filter("set_id != least").groupBy("set_id").agg(F.collect_set("least").alias("below"))
    near = cut_lineage(near)
    ties = near.select(F.col("set_id").alias("a"), F.explode("below").alias("b"))
    candidates = cut_lineage(components(ties).withColumnRenamed("v", "set_id").withColumnRenamed("root", "part"))

    wanted = candidates.join(sets.select("set_id", "first"), "set_id").select(F.col("first").alias("key")).distinct()
    texts = rows.join(wanted, rows["key"].eqNullSafe(wanted["key"]), "left_semi")
    full = cut_lineage(_full_sets(texts, words).join(candidates, "set_id", "left_semi").dropDuplicates(["set_id"]))

    stars = near.select(F.col("set_id").alias("a"), F.array_min("below").alias("b"))
    stars = stars.join(full.select(F.col("set_id").alias("a"), F.col("grams").alias("left")), "a")
    stars = stars.join(full.select(F.col("set_id").alias("b"), F.col("grams").alias("right")), "b")
    linked_sets = cut_lineage(_confirmed(stars, percent))
    first_roots = components(linked_sets).withColumnRenamed("v", "set_id")
    classed = candidates.join(first_roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    classed = cut_lineage(classed)

    # a group's largest class stands in blocks of its own, which need not meet each other
    counts = classed.groupBy("part", "root").agg(F.count("*").alias("n"))
    groups = counts.groupBy("part").agg(
        F.count("*").alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")
    )
    groups = groups.filter("classes > 1").select(
        "part",
        F.col("top.root").alias("top"),
        F.ceil(F.col("top.n") / block).cast("int").alias("tops"),
        F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("others"),
    )
    open_sets = classed.join(groups, "part").withColumn("in_top", F.col("root") == F.col("top"))
    number = F.xxhash64("set_id")
    open_sets = open_sets.withColumn(
        "block",
        F.when(F.col("in_top"), F.pmod(number, F.col("tops"))).otherwise(F.col("tops") + F.pmod(number, F.col("others"))).cast("int"),
    )
    last = F.col("tops") + F.col("others") - 1
    open_sets = open_sets.join(sets.select("set_id", "size", "registers"), "set_id").join(full, "set_id")
    tiles = open_sets.withColumn("other", F.explode(F.sequence(F.when(F.col("in_top"), F.col("tops")).otherwise(0), last)))
    tiles = tiles.select(
        "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "set_id", "root", "block", "size", "registers", "grams",
    )
    more = cut_lineage(tiles.groupBy("part", "i", "j").applyInArrow(_tile(percent), "a binary, b binary"))

    own = classed.select(F.col("set_id").alias("a"), F.col("root").alias("b"))
    roots = components(own.union(more)).withColumnRenamed("v", "set_id")
    of_set = sets.select("set_id", "first").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = of_set.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = of_set.join(named, "root").select("set_id", "component_id")
    answer = signed.select("key", "set_id", "size").join(classes, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return answer.select(
        F.col("key").alias(key),
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def near_duplicates_sql(percent: int = PERCENT, words: int = WORDS) -> str:
    """The same in DuckDB's SQL over ``documents``, with all pairs that share a shingle and reachability by rounds."""
    columns = ", ".join(f"w[i + {k}]" for k in range(words))
    return rf"""WITH RECURSIVE split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM (
        SELECT doc_id, list_value({columns}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words} + 2)) AS i FROM split WHERE len(w) >= {words})
        UNION ALL SELECT doc_id, w FROM split WHERE len(w) BETWEEN 1 AND {words - 1})),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS MATERIALIZED (SELECT p.a, p.b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id) p
        JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b WHERE 100 * p.n >= {percent} * (s.n + t.n - p.n)),
    reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents
        UNION SELECT l.b, r.root FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.doc_id WHERE r.root < l.b)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
    LEFT JOIN sizes s ON s.doc_id = d.doc_id"""
