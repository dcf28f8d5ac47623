"""Similarity join on sets of word n-grams by banded MinHash, with every candidate verified on the full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import mix64, slices, texts_of, unused_name
from weftlink.plans.components import components
from weftlink.session import cut_lineage

WORDS, SIMILARITY = 5, 0.8
#: Chance that a pair of just the asked similarity shares a band, and the values in a band.
RECALL, BAND_ROWS = 0.999, 6
#: Sets of a component that are compared in one task; a larger component is cut into blocks, compared pair by pair.
BLOCK = 256
#: Small components go into tasks of about so many sets.
GROUP_SETS = 2000
#: Columns of a product of two blocks that are laid out at a time.
PANEL = 8192
SLICE_BYTES = 1 << 19

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_POWERS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, 257)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def band_count(similarity: float, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """The fewest bands for which a pair of this similarity shares one with the chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def gram_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, one after another, and how many each text has.

    Words are lower case, cut at white space. A text of fewer words than an n-gram is one n-gram; one of no words
    has none. A text's hashes are distinct and ascend.
    """
    return byte_gram_sets([t.lower().encode("utf-8", "surrogatepass") for t in texts], words)


def byte_gram_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``gram_sets`` of texts in UTF-8 whose letters already have the case that counts."""
    raw = [b" %b " % t for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if not len(first):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    letters = np.flatnonzero(~blank)
    begins = np.searchsorted(letters, first)
    place = np.arange(len(letters)) - np.repeat(begins, np.diff(begins, append=len(letters)))
    hashes = mix64(np.add.reduceat(_BYTE[data[letters]] * _POWERS[place & 255] + (place >> 8).astype(np.uint64), begins))
    ends = np.cumsum([len(r) for r in raw])
    bounds = np.searchsorted(first, np.concatenate([[0], ends]))
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(words):
        rolled[: len(hashes) - k] = rolled[: len(hashes) - k] * _STEP + hashes[k:] if k else hashes
    rolled = mix64(rolled)
    parts = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            parts.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            few = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                few = mix64(few * _STEP + hashes[k : k + 1])
            parts.append(few)
        else:
            parts.append(hashes[:0])
    return np.concatenate(parts), np.array(list(map(len, parts)), dtype=np.int64)


def set_ids(grams: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """Sixteen bytes that name each set; None for an empty one."""
    out: list[bytes | None] = [None] * len(sizes)
    some = np.flatnonzero(sizes)
    if len(some):
        begins = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        one = mix64(np.add.reduceat(mix64(grams ^ _STEP), begins) + sizes[some].astype(np.uint64))
        two = mix64(np.add.reduceat(mix64(grams + _STEP) | np.uint64(1), begins) ^ _STEP)
        for i, a, b in zip(some.tolist(), one.tolist(), two.tolist(), strict=True):
            out[i] = a.to_bytes(8, "big") + b.to_bytes(8, "big")
    return out


def band_hashes(grams: np.ndarray, sizes: np.ndarray, bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """A hash of each band of each set that is not empty."""
    begins = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]]).astype(np.int64)
    factors = np.random.default_rng(rows).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(begins), bands), dtype=np.uint64)
    for band in range(bands):
        mixed = np.full(len(begins), np.uint64(band))
        for factor in factors[band * rows : (band + 1) * rows]:
            mixed = mix64(mixed * _STEP + np.minimum.reduceat(grams * factor, begins))
        out[:, band] = mixed
    return out


def _signatures(docs: DataFrame, bands: int, words: int) -> DataFrame:
    """``key, set_id, bands`` of ``key, text``; both null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                grams, sizes = gram_sets(texts_of(rows, "text"), words)
                made = iter(band_hashes(grams, sizes, bands).view(np.int64) if len(grams) else ())
                lists = [next(made) if n else None for n in sizes.tolist()]
                arrays = [rows.column("key"), pa.array(set_ids(grams, sizes), pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "set_id", "bands"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, set_id binary, bands array<long>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``set_id, grams`` of ``key, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                grams, sizes = gram_sets(texts_of(rows, "text"), words)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(grams, sizes), pa.binary()), lists], names=["set_id", "grams"])

    return docs.mapInArrow(run, "set_id binary, grams array<long>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left shares with each on the right, as products of panels of 0 and 1."""
    every = np.concatenate([*left, *right])
    values, column, times = np.unique(every, return_inverse=True, return_counts=True)
    # a value of one set only is shared by none
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for a in range(0, int((times > 1).sum()), PANEL):
        low, high = np.searchsorted(place, [a, a + PANEL])
        panel = np.zeros((len(left) + len(right), PANEL), dtype=np.float32)
        panel[row[low:high], place[low:high] - a] = 1
        out += (panel[: len(left)] @ panel[len(left) :].T).astype(np.int64)
    return out


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Where the Jaccard similarity is at least so much; without rounding in the last place."""
    shared = shared_counts(left, right)
    union = np.array(list(map(len, left)))[:, None] + np.array(list(map(len, right)))[None, :] - shared
    return (shared >= similarity * union - 1e-9) & (shared > 0)


def _verify(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        ids, parts = rows["set_id"].to_pylist(), rows["component"].to_pylist()
        copies, blocks = rows["copies"].to_numpy(), rows["block"].to_numpy()
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        sets = [s.values.to_numpy() for chunk in rows["grams"].chunks for s in chunk]
        links, root = np.zeros(len(ids), dtype=np.int64), list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        members: dict[bytes, list[int]] = {}
        for at, part in enumerate(parts):
            members.setdefault(part, []).append(at)
        for inside in members.values():
            left = np.array([x for x in inside if blocks[x] == i])
            right = left if i == j else np.array([x for x in inside if blocks[x] == j])
            if not len(left) or not len(right):
                continue
            found = similar_pairs([sets[x] for x in left], [sets[x] for x in right], similarity)
            if i == j:
                np.fill_diagonal(found, False)
            links[left] += found @ copies[right]
            if i != j:
                links[right] += found.T @ copies[left]
            for x, y in zip(*np.nonzero(found), strict=True):
                a, b = find(left[x]), find(right[y])
                root[max(a, b, key=lambda v: ids[v])] = min(a, b, key=lambda v: ids[v])
        return pa.table(
            {
                "set_id": rows["set_id"],
                "links": pa.array(links),
                "root": pa.array([ids[find(x)] for x in range(len(ids))], pa.binary()),
            }
        )

    return run


def similarity_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS
) -> DataFrame:
    """``key, class_id, n_links`` for each row: its class of similar texts, and how many other rows it is similar to.

    Two texts are similar if the Jaccard similarity of their sets of word n-grams is at least ``similarity``.
    A class is a connected component of similar texts; its id is the smallest key in it. Texts with equal sets are one
    set with a number of copies. Sets that share a band are in one candidate component; within it all pairs of sets are
    verified on the full sets, in blocks, so no pair is passed on and no task holds more than two blocks.

    A null or empty text is similar to none: its class is its own key, with no links. Null keys are allowed; they
    never name a class unless all of its keys are null. Repeated rows are copies. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = cut_lineage(_signatures(rows, band_count(similarity), words))
    some = signed.filter("set_id is not null")
    sets = cut_lineage(
        some.groupBy("set_id").agg(F.min("key").alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    )
    placed = sets.select("set_id", F.posexplode("bands").alias("band", "h"))
    buckets = placed.groupBy("band", "h").agg(F.min("set_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    near = placed.join(buckets, ["band", "h"]).filter("set_id != least").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    candidates = components(near.distinct()).withColumnRenamed("root", "component")
    members = candidates.withColumnRenamed("v", "set_id").join(sets.select("set_id", "first", "copies"), "set_id")
    members = cut_lineage(members.join(candidates.groupBy("component").agg(F.count("*").alias("size")), "component"))

    wanted = members.select(F.col("first").alias("key")).distinct()
    texts = rows.join(wanted, rows["key"].eqNullSafe(wanted["key"]), "left_semi")
    full = _full_sets(texts, words).join(members, "set_id", "left_semi").dropDuplicates(["set_id"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    groups = max(1, -(-members.count() // GROUP_SETS))
    cut = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    tiles = cut.join(full, "set_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1
    tiles = tiles.select(
        F.when(alone, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(-1).alias("g"),
        F.when(~alone, F.col("component")).alias("c"),
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "set_id", "component", "block", "copies", "grams",
    )
    verified = cut_lineage(
        tiles.groupBy("g", "c", "i", "j").applyInArrow(_verify(similarity), "set_id binary, links long, root binary")
    )
    linked = verified.groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    classed = sets.select("set_id", "first", "copies").join(classes.withColumnRenamed("v", "set_id"), "set_id", "left")
    classed = classed.withColumn("root", F.coalesce("root", "set_id"))
    named = classed.groupBy("root").agg(F.min("first").alias("class_id"))
    of_set = classed.join(named, "root").join(linked, "set_id", "left").select(
        "set_id", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return signed.select("key", "set_id").join(of_set, "set_id", "left").select(
        F.col("key").alias(key),
        F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each_class(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` but for all save one of each class, with all their columns; empty texts all stay."""
    name = unused_name(docs, "row")
    numbered = cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()))
    classes = similarity_classes(numbered, name, text, similarity, words)
    others = classes.filter(F.col(name) != F.col("class_id")).select(name)
    return numbered.join(others, name, "left_anti").drop(name)
