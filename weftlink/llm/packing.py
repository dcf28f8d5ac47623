"""Sum-of-squares packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.llm.common import slices, texts_of
from weftlink.llm.word_ids import WORD_FILE, word_encoder
from weftlink.session import cut_lineage

SEQUENCE = 4096
#: Pieces that one task packs, on average; what stays open at the end of a group is its only loss.
GROUP_PIECES = 200_000
SLICE_BYTES = 4 << 20


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    Items come longest first. An item goes where the sum of the squared counts of open bins for each gap grows
    least: into a bin of some gap, or a new bin. Ties go to the smallest gap left, so a bin that it fills wins.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; full bins and new ones do not count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        # a bin of gap g + size gets gap g; full bins (gap 0) are no longer counted
        change = 2 * (count[: capacity - size] - count[size:capacity]) + 2
        change[:1] -= 1
        change[count[size:capacity] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if size < capacity else -1
        fresh = 2 * count[capacity - size] + 1
        if best >= 0 and change[best] <= fresh:
            gap = best + size
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        left = gap - size
        if left:
            count[left] += 1
            stacks[left].append(b)
    return bins, offsets


def pack(pieces: DataFrame, length: str = "length", capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; all other columns stay.

    Lengths are 1 to ``capacity``; a null or other length raises. Pieces are dealt at random into groups of about
    ``group_pieces`` rows, each packed in one task. Columns that are named like the two new ones are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset", "_group")
    # the place in the stored table decides, so copies and hot keys spread like any row
    dealt = cut_lineage(pieces.withColumn("_group", F.xxhash64(F.monotonically_increasing_id())))
    groups = max(1, -(-dealt.count() // group_pieces))
    names = pieces.columns

    def place(rows: pa.Table) -> pa.Table:
        lengths = rows[length].to_numpy()
        if rows[length].null_count or lengths.min() < 1 or lengths.max() > capacity:
            raise ValueError(f"lengths must be 1 to {capacity}")
        bins, offsets = sum_of_squares(lengths.astype(np.int64), capacity)
        first = rows["_group"][0].as_py() << 32
        return rows.select(names).append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    schema = T.StructType([*pieces.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset"))])
    return dealt.withColumn("_group", F.pmod("_group", F.lit(groups))).groupBy("_group").applyInArrow(place, schema)


def token_pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str = WORD_FILE,
    end_id: int = 1,
    capacity: int = SEQUENCE,
    keep_ids: bool = False,
) -> DataFrame:
    """Cut the ids of each whole text and an end id into pieces of ``capacity``; the last may be shorter.

    Null texts count as empty (the end id alone). Other columns of ``docs`` are not read. ``keep_ids`` adds the
    ids as an array.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def cut(batches):
        encoder = word_encoder(path)
        width, end = encoder.dtype.itemsize, np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                at, number, start, length, crc, kept = [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode(texts_of(rows, "text"))):
                    raw += end
                    for p, a in enumerate(range(0, len(raw) // width, capacity)):
                        ids = np.frombuffer(raw[a * width : (a + capacity) * width], dtype=encoder.dtype).astype("<u4")
                        at.append(i)
                        number.append(p)
                        start.append(a)
                        length.append(len(ids))
                        crc.append(zlib.crc32(ids.tobytes()))
                        if keep_ids:
                            kept.append(ids.tolist())
                arrays = [
                    rows.column("key").take(pa.array(at, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ] + ([pa.array(kept, pa.list_(pa.int64()))] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    columns = [key, "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    schema = f"`{key}` {key_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: its document, place in it, checksum of its ids, sequence and place there."""
    return pack(token_pieces(docs, key, text, keep_ids=keep_ids))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, lengths`` of pieces that were packed with their ids, in order of the offset."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths")
    )
