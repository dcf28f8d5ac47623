"""Token-id shards with a minimal perfect hash index over the document keys.

A shard is one binary file: a header, the raw ids of its documents one after another, the place of every document
and a trailer. Shards hold ascending keys. The index is cut into buckets by a hash of the key; each bucket has a
minimal perfect hash (cascaded bitmaps), a stored fingerprint for each slot, and the runs of documents that have
the slot's key. A lookup evaluates the hash, compares the fingerprint and reads two places of the shard's table,
whatever the number of documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.common import full_uri, mix64, slices, texts_of
from weftlink.llm.word_ids import WORD_FILE, word_encoder
from weftlink.session import cut_lineage, shared_dir

MAGIC = b"WTIDS001"
#: Documents, bytes of an id, magic.
TRAILER = "<qq8s"
TRAILER_BYTES = struct.calcsize(TRAILER)
#: Keys in a bucket of the index, on average.
BUCKET_KEYS = 50_000
#: Bytes of text that a task encodes at a time.
SLICE_BYTES = 4 << 20


# --- minimal perfect hash ----------------------------------------------------------------------------------------


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h1 + np.uint64(level) * (h2 | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def build_mph(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of the levels. Keys alone at their place in a level stop there, the rest go on to the next."""
    levels, rest = [], np.arange(len(h1))
    while len(rest):
        size = 2 * len(rest) + 1
        at = _place(h1[rest], h2[rest], len(levels), size)
        count = np.bincount(at, minlength=size)
        levels.append(count == 1)
        rest = rest[count[at] > 1]
    return levels


def mph_slots(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """A slot from 0 to n - 1 for each key; -1 where no level has a bit for it."""
    slots = np.full(len(h1), -1, dtype=np.int64)
    rest, base = np.arange(len(h1)), 0
    for level, bits in enumerate(levels):
        at = _place(h1[rest], h2[rest], level, len(bits))
        hit = bits[at]
        slots[rest[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        rest, base = rest[~hit], base + int(bits.sum())
    return slots


# --- shards --------------------------------------------------------------------------------------------------------


def _shard_writer(root: str, path: str, end_id: int, key_type: pa.DataType):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_encoder(path), TaskContext.get()
        width = encoder.dtype.itemsize
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        fs, folder = pafs.FileSystem.from_uri(root)
        # an attempt writes a file of its own; only files of finished attempts get into the table of documents
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.bin"
        out, places = None, [0]
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                out = out or fs.open_output_stream(f"{folder}/{name}")
                if len(places) == 1:
                    out.write(MAGIC)
                payloads = [ids + end for ids in encoder.encode(texts_of(rows, "text"))]
                first = len(places) - 1
                counts = [len(p) // width for p in payloads]
                for n in counts:
                    places.append(places[-1] + n)
                out.write(b"".join(payloads))
                n = len(payloads)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("key").cast(key_type),
                        pa.array([task.partitionId()] * n, pa.int32()),
                        pa.array([name] * n, pa.string()),
                        pa.array(range(first, first + n), pa.int64()),
                        pa.array(counts, pa.int64()),
                    ],
                    names=["key", "shard", "file", "ordinal", "n_tokens"],
                )
        if out:
            out.write(np.array(places, dtype="<i8").tobytes())
            out.write(struct.pack(TRAILER, len(places) - 1, width, MAGIC))
            out.close()

    return write


class Shard:
    """Keyed reads from one shard file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.n, self.width, magic = struct.unpack(TRAILER, self.file.read_at(TRAILER_BYTES, size - TRAILER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        self.table = size - TRAILER_BYTES - 8 * (self.n + 1)
        self.dtype = np.dtype(f"<u{self.width}")

    def places(self, ordinal: int, count: int) -> np.ndarray:
        """Where ``count`` documents from ``ordinal`` start, and where the last one ends."""
        return np.frombuffer(self.file.read_at(8 * (count + 1), self.table + 8 * ordinal), dtype="<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(raw, dtype=self.dtype)


# --- index ---------------------------------------------------------------------------------------------------------


def _hashed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Two hashes of the key (null has its own) and its bucket."""
    h1, h2 = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    return df.withColumns({"h1": h1, "h2": h2, "bucket": F.pmod(F.xxhash64(F.lit(2), key), F.lit(buckets)).cast("int")})


INDEX_SCHEMA = (
    "bucket int, n_keys long, level_sizes array<long>, bits binary, fingerprints binary, run_ends binary,"
    " shards binary, ordinals binary, counts binary"
)


def _u64(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _index_bucket(rows: pa.Table) -> pa.Table:
    pairs = np.stack([_u64(rows["h1"]), _u64(rows["h2"])], axis=1)
    keys, which = np.unique(pairs, axis=0, return_inverse=True)
    levels = build_mph(keys[:, 0], keys[:, 1])
    slot = mph_slots(levels, keys[:, 0], keys[:, 1])
    fingerprints = np.empty(len(keys), dtype="<u4")
    fingerprints[slot] = (keys[:, 1] >> np.uint64(32)).astype("<u4")
    of_row = slot[which.reshape(-1)]
    shards, ordinals = rows["shard"].to_numpy(), rows["ordinal"].to_numpy()
    order = np.lexsort((ordinals, shards, of_row))
    return pa.table(
        {
            "bucket": pa.array([rows["bucket"][0].as_py()], pa.int32()),
            "n_keys": pa.array([len(keys)], pa.int64()),
            "level_sizes": pa.array([[len(b) for b in levels]], pa.list_(pa.int64())),
            "bits": pa.array([np.packbits(np.concatenate(levels)).tobytes()], pa.binary()),
            "fingerprints": pa.array([fingerprints.tobytes()], pa.binary()),
            "run_ends": pa.array([np.cumsum(np.bincount(of_row, minlength=len(keys))).astype("<i8").tobytes()], pa.binary()),
            "shards": pa.array([shards[order].astype("<i4").tobytes()], pa.binary()),
            "ordinals": pa.array([ordinals[order].astype("<i8").tobytes()], pa.binary()),
            "counts": pa.array([rows["count"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
        }
    )


def _look_up(keys: pa.Table, index: pa.Table) -> pa.Table:
    schema = pa.schema(
        [("key", keys.schema.field("key").type), ("shard", pa.int32()), ("ordinal", pa.int64()), ("count", pa.int64())]
    )
    if not len(keys) or not len(index):
        return schema.empty_table()
    row = index.slice(0, 1).to_pylist()[0]
    bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8)).astype(bool)
    cuts = np.cumsum(row["level_sizes"])
    levels = np.split(bits[: cuts[-1]], cuts[:-1])
    h1, h2 = _u64(keys["h1"]), _u64(keys["h2"])
    slot = mph_slots(levels, h1, h2)
    known = np.frombuffer(row["fingerprints"], dtype="<u4")[slot] == (h2 >> np.uint64(32)).astype("<u4")
    found = np.flatnonzero((slot >= 0) & known)
    ends = np.frombuffer(row["run_ends"], dtype="<i8")
    last = ends[slot[found]]
    first = np.where(slot[found] > 0, ends[slot[found] - 1], 0)
    n = last - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else first, n) + np.arange(n.sum())
    return pa.table(
        [
            keys["key"].take(pa.array(np.repeat(found, n))),
            pa.array(np.frombuffer(row["shards"], dtype="<i4")[at]),
            pa.array(np.frombuffer(row["ordinals"], dtype="<i8")[at]),
            pa.array(np.frombuffer(row["counts"], dtype="<i8")[at]),
        ],
        schema=schema,
    )


# --- the store -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TokenStore:
    """``shards``: shard, file, n_docs, n_tokens, base (ids of all shards before). ``index``: one row a bucket."""

    root: str
    shards: DataFrame
    index: DataFrame
    buckets: int
    key_type: str

    def look_up(self, keys: DataFrame, key: str) -> DataFrame:
        """``key, shard, ordinal, count``: the runs of documents that have each of the distinct keys asked for.

        Keys that the store lacks give no row, but for one in 2^32 that has the fingerprint of another.
        """
        asked = _hashed(keys.select(F.col(key).alias("key")).distinct(), "key", self.buckets)
        schema = f"key {self.key_type}, shard int, ordinal long, count long"
        return asked.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInArrow(_look_up, schema)

    def read(self, located: DataFrame, derive=None, schema: str = "ids array<long>") -> DataFrame:
        """``key, start, n_tokens`` and what ``derive`` (a list of id arrays to Arrow columns) makes of the ids.

        ``start`` counts the ids of all documents before. Without ``derive`` the ids themselves come back.
        """
        root, key_type = self.root, self.key_type
        made = derive or (lambda ids: [pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))])
        names = ["key", "start", "n_tokens", *(part.split()[0] for part in schema.split(","))]

        def fetch(batches):
            fs, folder = pafs.FileSystem.from_uri(root)
            name, shard = None, None
            for batch in batches:
                columns = {c: batch.column(c).to_pylist() for c in ("file", "base", "ordinal", "count")}
                at, starts, ids, held = [], [], [], 0

                def packed():
                    return pa.RecordBatch.from_arrays(
                        [
                            batch.column("key").take(pa.array(at, pa.int64())),
                            pa.array(starts, pa.int64()),
                            pa.array([len(x) for x in ids], pa.int64()),
                            *made(ids),
                        ],
                        names=names,
                    )

                for i, (file, base, ordinal, count) in enumerate(zip(*columns.values(), strict=True)):
                    if file != name:
                        name, shard = file, Shard(fs, f"{folder}/{file}")
                    places = shard.places(ordinal, count)
                    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
                        at.append(i)
                        starts.append(base + a)
                        ids.append(shard.ids(a, b))
                        held += b - a
                        if held > 1 << 21:
                            yield packed()
                            at, starts, ids, held = [], [], [], 0
                if at:
                    yield packed()

        runs = located.join(self.shards.select("shard", "file", "base"), "shard").repartition("shard")
        return runs.sortWithinPartitions("shard", "ordinal").mapInArrow(
            fetch, f"key {key_type}, start long, n_tokens long, {schema}"
        )


def write_token_store(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = WORD_FILE, end_id: int = 1
) -> TokenStore:
    """Encode whole texts, append ``end_id`` to each, and store the ids in ascending order of the key.

    Null texts count as empty; a null key sorts first and can be looked up; rows that share a key are kept, one
    behind another, ordered by a hash of the text. Other columns of ``docs`` are not read. An empty table gives a
    store without shards.
    """
    spark = docs.sparkSession
    root = full_uri(spark, f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}")
    fs, folder = pafs.FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()
    arrow_type = pa.string() if key_type == "string" else pa.from_numpy_dtype({"bigint": "i8", "int": "i4"}[key_type])
    placed = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text"))
    documents = cut_lineage(
        placed.mapInArrow(
            _shard_writer(root, path, end_id, arrow_type),
            f"key {key_type}, shard int, file string, ordinal long, n_tokens long",
        )
    )
    # shards are few: one row for each task that wrote
    shards = cut_lineage(
        documents.groupBy("shard", "file")
        .agg(F.min("key").alias("first_key"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn(
            "base",
            F.coalesce(
                F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
    )
    n_docs = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    buckets = max(1, -(-n_docs // BUCKET_KEYS))
    # a key's rows in a shard are neighbours: one run, however many they are
    runs = documents.groupBy("key", "shard").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("count"))
    index = cut_lineage(
        _hashed(runs, "key", buckets).drop("key").groupBy("bucket").applyInArrow(_index_bucket, INDEX_SCHEMA)
    )
    return TokenStore(root, shards, index, buckets, key_type)


def crc_of_ids(ids: list[np.ndarray]) -> list[pa.Array]:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return [pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]


def stored_token_digests(docs: DataFrame, key: Column | str = "doc_id") -> DataFrame:
    """Write all documents, look every key up in the index and digest what the shards give back."""
    store = write_token_store(docs, key)
    found = store.read(store.look_up(docs, key), crc_of_ids, "ids_crc32 long")
    return found.withColumnRenamed("key", key)
