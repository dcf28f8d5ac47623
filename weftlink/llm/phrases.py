"""Document fingerprints from locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import mix64, slices, texts_of

#: A fingerprint keeps the phrase names in this share of all numbers, so it grows with its text and passages keep theirs;
#: of a text with fewer such names it keeps so many of the smallest, or all it has.
SHARE, KEPT = 1 / 16, 64
_BOUND = np.uint64(int(2**64 * SHARE))
#: Levels whose phrases count: those of about six characters and more.
FIRST_LEVEL = 2
#: Code points that a task parses at a time, and bytes of text it takes from a batch.
SLICE_BYTES = 1 << 19
#: Rows of a run of neighbouring documents, and the most runs there are; a task streams a run, whatever its length.
RUN_ROWS, MOST_RUNS = 2000, 10_000

_SEED = np.uint64(0x9E3779B97F4A7C15)
_DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)
_BIT = np.empty(64, dtype=np.uint8)
_BIT[[(((1 << k) * 0x03F79D71B4CB0A89) & ((1 << 64) - 1)) >> 58 for k in range(64)]] = np.arange(64)


def _coin(a: int, b: int) -> int:
    k = ((a ^ b) & -(a ^ b)).bit_length() - 1 if a != b else 0
    return 2 * k + ((a >> k) & 1)


#: The later rounds: the label of a symbol under 128 and the one before it.
_TOSS = np.array([[_coin(a, b) for b in range(128)] for a in range(128)], dtype=np.uint8).reshape(-1)
_POWERS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, 257)], dtype=np.uint64)


def _blocks(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where blocks start in a row of names without equal neighbours; ``first`` marks the start of each text.

    Deterministic coin tossing gives each name a label from the lowest bit in which it differs from the name before.
    Repeated on the labels, this leaves six of them, still without equal neighbours; blocks start at local minima.
    A label depends on four names to the left, a start on one more to the right: equal substrings are cut alike
    but for a few names at their ends.
    """
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = _SEED
    differ = names ^ before
    bit = _BIT[((differ & (~differ + np.uint64(1))) * _DEBRUIJN) >> np.uint64(58)]
    label = (2 * bit + ((names >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = 127 - label[first]
        label = _TOSS[label.astype(np.intp) * 128 + left]
    start = np.zeros(len(names), dtype=bool)
    start[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    # a start right behind the first name of a text, or on its last one, would make a block of one name
    start[1:] &= ~first[:-1]
    start[:-1] &= ~first[1:]
    start[first] = True
    return start


def phrase_names(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level from 1: the text of each phrase, and its name. Ends when each text is one phrase."""
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    while len(names):
        first = np.ones(len(names), dtype=bool)
        np.not_equal(owner[1:], owner[:-1], out=first[1:])
        # a run of one name becomes one name, made of it and the length
        fresh = first.copy()
        fresh[1:] |= names[1:] != names[:-1]
        at = np.flatnonzero(fresh)
        if len(at) < len(names):
            runs = np.diff(at, append=len(names)).astype(np.uint64)
            names, owner, first = names[at], owner[at], first[at]
            names = np.where(runs > 1, mix64(names + runs * _SEED), names)
        start = np.flatnonzero(_blocks(names, first))
        place = np.arange(len(names)) - np.repeat(start, np.diff(start, append=len(names)))
        names = mix64(np.add.reduceat(mix64(names) * _POWERS[place & 255], start))
        owner = owner[start]
        yield owner, names
        alone = np.bincount(owner, minlength=len(texts)) == 1
        if alone[owner].any():
            more = ~alone[owner]
            names, owner = names[more], owner[more]


def fingerprints(texts: list[str], kept: int = KEPT, first_level: int = FIRST_LEVEL) -> list[np.ndarray]:
    """For each text the distinct phrase names of its levels from ``first_level`` that are kept, ascending.

    These are all within ``SHARE`` of the numbers there are, and the ``kept`` smallest in any case.
    A text whose parsing ends below that level has the name of its last phrase. An empty text has none.
    """
    owners, names, seen = [], [], np.zeros(len(texts), dtype=bool)
    waiting: tuple[np.ndarray, np.ndarray] | None = None
    for level, (owner, name) in enumerate(phrase_names(texts), 1):
        if level >= first_level:
            owners.append(owner)
            names.append(name)
            seen[owner] = True
        else:
            count = np.bincount(owner, minlength=len(texts))
            alone = count[owner] == 1
            waiting = (owner[alone], name[alone]) if waiting is None else tuple(map(np.concatenate, zip(waiting, (owner[alone], name[alone]))))  # noqa: B905
    if waiting is not None:
        late = ~seen[waiting[0]]
        owners.append(waiting[0][late])
        names.append(waiting[1][late])
    if not owners:
        return [np.empty(0, dtype=np.uint64)] * len(texts)
    owner, name = np.concatenate(owners), np.concatenate(names)
    total = np.bincount(owner, minlength=len(texts))
    # names are uniform: three times as many as needed lie below this limit; where copies leave too few, all are taken
    limit = np.where(total > 3 * kept, np.maximum(3 * kept / np.maximum(total, 1), 1.001 * SHARE), 1.0) * 2.0**64
    below = name.astype(np.float64) <= limit[owner]
    got = _smallest(owner[below], name[below], len(texts), kept)
    for i in np.flatnonzero((np.array([len(g) for g in got]) < kept) & (total > 3 * kept)):
        got[i] = np.unique(name[owner == i])[:kept]  # too few names lie below the limit, so none more below the bound
    return got


def _smallest(owner: np.ndarray, name: np.ndarray, n: int, kept: int) -> list[np.ndarray]:
    order = np.lexsort((name, owner))
    owner, name = owner[order], name[order]
    new = np.ones(len(name), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (name[1:] != name[:-1])
    owner, name = owner[new], name[new]
    ends = np.searchsorted(owner, np.arange(n + 1))
    low = np.concatenate([[0], np.cumsum(name < _BOUND)])
    return [name[a : min(b, a + max(kept, int(low[b] - low[a])))] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Twice the shared phrases over the phrases of both, estimated from the names up to where both fingerprints are whole."""
    if not len(a) and not len(b):
        return 1.0
    reach = min((max(f[-1], _BOUND - np.uint64(1)) for f in (a, b) if len(f) >= kept), default=None)
    if reach is not None:
        a, b = a[: np.searchsorted(a, reach, side="right")], b[: np.searchsorted(b, reach, side="right")]
    shared = len(np.intersect1d(a, b, assume_unique=True))
    j = shared / max(len(a) + len(b) - shared, 1)
    return 2 * j / (1 + j)


def as_text(fingerprint: np.ndarray) -> str:
    """Sixteen hexadecimal digits a name."""
    return fingerprint.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` of each whole text. Null texts count as empty, whose fingerprint is the empty string.

    One row for each row of ``docs``; other columns are not read.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                made = list(map(as_text, fingerprints(texts_of(rows, "text"))))
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(made, pa.string())], names=["key", "fingerprint"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {key_type}, fingerprint string").withColumnRenamed("key", key)


def runs_with_successor(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``run, guest, key, text``, partitioned by run and sorted: neighbouring documents in ascending order of the key.

    Each run also has, as its last row and marked as guest, the document that comes after it; after the last run
    comes the first document of all. Null keys come first, equal keys go by a hash of the text.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = rows.select("key")
    n = keys.count()
    wanted = min(MOST_RUNS, -(-n // RUN_ROWS))
    places = [i / wanted for i in range(1, wanted)]
    edges = keys.agg(F.percentile_approx("key", places, 10 * wanted)).first()[0] if places else []
    splits = [-float("inf"), *sorted({float(e) for e in edges or [0]}), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="x", outputCol="b", handleInvalid="keep")

    def with_run(df: DataFrame) -> DataFrame:
        at = bucketizer.transform(df.withColumn("x", F.coalesce(F.col("key").cast("double"), F.lit(0.0))))
        return at.withColumn("run", F.when(F.col("key").isNull(), -1).otherwise(F.col("b").cast("int"))).drop("x", "b")

    # one row a run, so at most MOST_RUNS + 1
    heads = sorted((r["run"], r["head"]) for r in with_run(keys).groupBy("run").agg(F.min("key").alias("head")).collect())
    before = [(run, head, heads[i - 1][0]) for i, (run, head) in enumerate(heads)]
    guests = docs.sparkSession.createDataFrame(before, "g_run int, head long, host int")
    placed = with_run(rows).join(
        F.broadcast(guests), (F.col("run") == F.col("g_run")) & F.col("key").eqNullSafe(F.col("head")), "left"
    )
    own = F.struct("run", F.lit(False).alias("guest"))
    also = F.struct(F.col("host").alias("run"), F.lit(True).alias("guest"))
    at = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, also))
    spread = placed.select(F.explode(at).alias("at"), "key", "text").select("at.run", "at.guest", "key", "text")
    return spread.repartition("run").sortWithinPartitions("run", "guest", F.col("key").asc_nulls_first(), F.xxhash64("text"))


def edited_text(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by the first as many code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_sensitivity(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How fingerprints follow an edit: each text against itself with its last half replaced, and against the next.

    ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next document is
    the one with the next larger key, after the last the first; a single document follows itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # run, guest, key, text, fingerprint of the row before
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                runs, guest, keys = (part.column(c).to_pylist() for c in ("run", "guest", "key"))
                rows = list(zip(runs, guest, keys, texts_of(part, "text"), strict=True))
                prints = fingerprints([r[3] for r in rows])
                chain = ([last] if last else []) + [(*r, p) for r, p in zip(rows, prints, strict=True)]
                pairs = [(a, b) for a, b in zip(chain, chain[1:]) if not a[1] and a[0] == b[0]]  # noqa: B905
                last = chain[-1]
                edits = [edited_text(a[3], b[3]) for a, b in pairs]
                edit_prints = fingerprints(edits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                        pa.array([as_text(a[4]) for a, _ in pairs], pa.string()),
                        pa.array([as_text(p) for p in edit_prints], pa.string()),
                        pa.array([likeness(a[4], p) for (a, _), p in zip(pairs, edit_prints, strict=True)], pa.float64()),
                        pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                    ],
                    names=names,
                )

    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (
        "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    return runs_with_successor(docs, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
