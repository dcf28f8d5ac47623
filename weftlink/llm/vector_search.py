"""Exact nearest neighbours by a block matrix join on int8 products."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.session import cut_lineage

#: Rows of a block of queries and of a block of candidates; a task holds one of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 16384
#: Candidates of a block that are multiplied at a time.
PANEL = 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and how far each row is from scale times codes."""
    top = np.abs(x).max(axis=1)
    # rows of numbers near the limits of float64 would not keep finite products
    scale = np.where(top > 0, top, 1.0) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def nearest_in_tile(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> list[list[tuple]]:
    """The ``k`` nearest candidates (distance, id) of each query in a tile, without the query's own id.

    int8 products give each distance up to the two rows' quantisation errors. A pair survives if its lower bound is
    not above the k-th smallest upper bound of its query; survivors get the distance of the original vectors in
    float64 and go through a heap of the ``k`` best.
    """
    qc, qs, qe = quantise(q)
    heaps: list[list[tuple]] = [[] for _ in q_ids]
    wide = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products stay exact integers
    q_norm = (qs**2) * (qc.astype(np.int64) ** 2).sum(axis=1)
    reach = np.full(len(q_ids), np.inf)
    for a in range(0, len(c_ids), PANEL):
        part, ids = c[a : a + PANEL], c_ids[a : a + PANEL]
        cc, cs, ce = quantise(part)
        c_norm = (cs**2) * (cc.astype(np.int64) ** 2).sum(axis=1)
        dots = (qc.astype(wide) @ cc.astype(wide).T).astype(np.float64)
        square = q_norm[:, None] + c_norm[None, :] - 2 * (qs[:, None] * cs[None, :]) * dots
        slack = qe[:, None] + ce[None, :]
        # float64 rounding of the squares, far above what it can be
        round_off = 1e-12 * (q_norm[:, None] + c_norm[None, :])
        upper = np.sqrt(np.maximum(square, 0) + round_off) + slack
        lower = np.sqrt(np.maximum(square - round_off, 0)) - slack
        own = q_ids[:, None] == ids[None, :]
        upper[own] = np.inf
        if len(ids) >= k:
            reach = np.minimum(reach, np.partition(upper, k - 1, axis=1)[:, k - 1])
        for i, j in zip(*_grouped((lower <= reach[:, None] * (1 + 1e-12)) & ~own), strict=True):
            exact = np.sqrt(((q[i] - part[j]) ** 2).sum(axis=1))
            best = heapq.nsmallest(k, zip(exact.tolist(), ids[j].tolist(), strict=True))
            heaps[i] = list(heapq.merge(heaps[i], best))[:k]
            if len(heaps[i]) == k:
                reach[i] = min(reach[i], heaps[i][-1][0])
    return heaps


def _grouped(mask: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    rows, columns = np.nonzero(mask)
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[starts].tolist(), np.split(columns, starts[1:]) if len(starts) else []


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest candidates by Euclidean distance in float64.

    All candidates are compared, the query's own id is not; ties go to the smaller id. Vectors that are null, zero,
    or hold a null or non-finite component take no part, nor do null keys. Only vectors of one length are compared.
    A query with fewer than ``k`` candidates gets them all. Rows of equal key and vector count once. Other columns
    are not read.

    Of candidates with the same vector only the k + 1 smallest ids can be among the nearest, so the rest are not
    compared: copies of one vector cost nothing.
    """

    def usable(df: DataFrame) -> DataFrame:
        wide = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return wide.filter(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("d", F.size("v"))

    same = Window.partitionBy("v").orderBy("id")
    distinct = usable(candidates).dropDuplicates(["id", "v"])
    kept = cut_lineage(distinct.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1).drop("r"))
    asked = cut_lineage(usable(queries).dropDuplicates(["id", "v"]))
    blocks = max(1, -(-asked.count() // query_block)), max(1, -(-kept.count() // candidate_block))

    def tiles(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    q = tiles(asked, "qb", blocks[0], "cb", blocks[1]).groupBy("qb", "cb", "d")
    c = tiles(kept, "cb", blocks[1], "qb", blocks[0]).groupBy("qb", "cb", "d")
    names = ["query_id", "vec_id", "score"]

    def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.combine_chunks()
        flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(rows), -1), rows["id"].to_numpy()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            (x, x_ids), (y, y_ids) = matrix(left), matrix(right)
            for i, best in zip(x_ids.tolist(), nearest_in_tile(x, x_ids, y, y_ids, k), strict=True):
                found += [(i, j, d) for d, j in best]
        return _table(found, names)

    def merge(rows: pa.Table) -> pa.Table:
        pairs = set(zip(rows["score"].to_pylist(), rows["vec_id"].to_pylist(), strict=True))
        best = heapq.nsmallest(k, pairs)
        query = rows["query_id"][0].as_py()
        return _table([(query, r, j, d) for r, (d, j) in enumerate(best, 1)], ["query_id", "rank", "vec_id", "score"])

    partial = q.cogroup(c).applyInArrow(compare, "query_id long, vec_id long, score double")
    return partial.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    types = {"rank": pa.int32(), "score": pa.float64()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table([pa.array(c, types.get(n, pa.int64())) for c, n in zip(columns, names, strict=True)], names=names)
