"""Lloyd's k-means on integer vectors, sharded by dimension: tasks hold column blocks and slices of the centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.session import cut_lineage

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Components of a column block, and vectors of a chunk.
SHARD, CHUNK = 16, 8192
#: Components beyond this would not leave room for exact squares in 64 bits: 64 * (2 * 2**27)**2 is the most.
BOUND = 1 << 27


def integer_vectors(df: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """``id, v``: vectors of just so many components, all finite, each as floor(scale * component) of its double."""
    wide = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dimensions)
    # a component that is not finite, or too large, has no exact integer here
    finite = wide.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < BOUND)))
    return finite.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors whose keys have the smallest sha256 of ``2:<key>``, in its order; a row without a key is none."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    rows = vectors.filter("id is not null").select(digest.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def column_blocks(vectors: DataFrame, dimensions: int, shard: int, chunk: int = CHUNK) -> DataFrame:
    """``chunk, ids, shard, block``: chunks of rows as read, each cut into column blocks of int32.

    A chunk's number holds its task and place, so nothing is shuffled; the table must be stored before it is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, len(batch), chunk):
                part = batch.slice(a, chunk)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), dimensions)
                ids = part.column("id").to_pylist()
                for s, first in enumerate(range(0, dimensions, shard)):
                    cell = np.ascontiguousarray(x[:, first : first + shard].astype("<i4")).tobytes()
                    # one block of each chunk carries the keys
                    arrays = [pa.array([v]) for v in (number, s, len(part))]
                    arrays += [pa.array([ids if s == 0 else None], pa.list_(pa.int64())), pa.array([cell], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "shard", "n", "ids", "block"])
                number += 1

    return vectors.mapInArrow(run, "chunk long, shard long, n long, ids array<long>, block binary")


def _matrix(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cell, dtype="<i4").reshape(n, -1).astype(np.int64)


def partial_distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of a column block to a slice of the centroids, exact in 64 bits."""
    if not len(block):
        return np.zeros((0, len(centroids)), dtype=np.int64)
    reach = int(np.abs(block).max()) + int(np.abs(centroids).max())
    if block.shape[1] * reach * reach < 1 << 52:  # products and sums stay exact in floats
        x, c = block.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return (block**2).sum(1)[:, None] - 2 * (block @ centroids.T) + (centroids**2).sum(1)[None, :]


def _assigned(blocks: DataFrame, slices: list[np.ndarray]) -> DataFrame:
    """``chunk, clusters, distances``: partial distances of the column blocks, added by chunk, and the least of each row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cell = partial_distances(_matrix(row["block"], row["n"]), slices[row["shard"]]).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([row["n"]]), pa.array([cell], pa.binary())], names=["chunk", "n", "partial"])

    def add(rows: pa.Table) -> pa.Table:
        n = rows["n"][0].as_py()
        total = sum(np.frombuffer(cell, dtype="<i8") for cell in rows["partial"].to_pylist()).reshape(n, -1)
        nearest = total.argmin(1)  # the first of equal ones
        cells = [nearest.astype("<i4").tobytes(), total[np.arange(n), nearest].astype("<i8").tobytes()]
        return pa.table({"chunk": rows["chunk"].slice(0, 1), "clusters": pa.array(cells[:1], pa.binary()), "distances": pa.array(cells[1:], pa.binary())})

    distances = blocks.select("chunk", "shard", "n", "block").mapInArrow(partial, "chunk long, n long, partial binary")
    return distances.groupBy("chunk").applyInArrow(add, "chunk long, clusters binary, distances binary")


def _updated(blocks: DataFrame, assigned: DataFrame, slices: list[np.ndarray]) -> list[np.ndarray]:
    """New slices of the centroids: sums by shard and cluster in tasks, each shard's floor of the mean in its own group."""
    clusters = len(slices[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((clusters, c.shape[1] + 1), dtype=np.int64) for c in slices]
        for batch in batches:
            for row in batch.to_pylist():
                x, cluster = _matrix(row["block"], row["n"]), np.frombuffer(row["clusters"], dtype="<i4")
                order = np.argsort(cluster, kind="stable")
                present, starts = np.unique(cluster[order], return_index=True)
                total = totals[row["shard"]]
                total[present, :-1] += np.add.reduceat(x[order], starts, axis=0)
                total[:, -1] += np.bincount(cluster, minlength=clusters)
        for s, total in enumerate(totals):
            if total[:, -1].any():
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["shard", "total"])

    def mean(rows: pa.Table) -> pa.Table:
        old = slices[rows["shard"][0].as_py()]
        total = np.zeros((clusters, old.shape[1] + 1), dtype=np.int64)
        total.ravel()[rows["at"].to_numpy()] = rows["x"].to_numpy()
        n = total[:, -1:]
        new = np.where(n > 0, total[:, :-1] // np.maximum(n, 1), old)
        return pa.table({"shard": rows["shard"].slice(0, 1), "slice": pa.array([new.ravel().tolist()], pa.list_(pa.int64()))})

    placed = blocks.select("chunk", "shard", "n", "block").join(assigned.select("chunk", "clusters"), "chunk")
    totals = placed.mapInArrow(sums, "shard long, total array<long>")
    # sums by task are added on Spark number by number; a shard's group holds clusters times its components
    cells = totals.select("shard", F.posexplode("total").alias("at", "x")).groupBy("shard", "at").agg(F.sum("x").alias("x"))
    out = list(slices)
    for row in cells.groupBy("shard").applyInArrow(mean, "shard long, slice array<long>").collect():
        out[row.shard] = np.array(row.slice, dtype=np.int64).reshape(out[row.shard].shape)
    return out


def lloyd(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    shard: int = SHARD,
    chunk: int = CHUNK,
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each vector that takes part.

    Vectors are integers (see ``integer_vectors``) and all arithmetic is exact. The first centroids are the vectors with
    the smallest key digests; fewer vectors than clusters make fewer clusters. Each round assigns every vector to its
    nearest centroid (ties: the smaller number) and then takes the floor of the mean of each cluster's vectors; an
    empty cluster keeps its centroid. After the last round vectors are assigned once more.

    A task holds one column block of one chunk of rows and only its slice of the centroids. Partial distances are added
    by chunk; each shard makes its own new slice from sums by task. The driver sees the slices, clusters times
    dimensions numbers, and no vectors.

    Null, short, long or non-finite vectors take no part, nor do those with a component of 2**27 / scale or more, whose
    distances a long could not hold. Rows without a key are assigned and counted but start no cluster. Repeated rows are
    rows of their own. Other columns are not read. An empty table gives no rows.
    """
    vectors = cut_lineage(integer_vectors(df, key, vector, dimensions, scale))
    centres = first_centroids(vectors, clusters)
    schema = "vec_id long, cluster int, distance long"
    if not len(centres):
        empty = df.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
        return empty.withColumnRenamed("vec_id", key)
    blocks = cut_lineage(column_blocks(vectors, dimensions, shard, chunk))
    slices = [centres[:, a : a + shard] for a in range(0, dimensions, shard)]
    for _ in range(rounds):
        slices = _updated(blocks, cut_lineage(_assigned(blocks, slices)), slices)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = [pa.array(row["ids"], pa.int64()), pa.array(np.frombuffer(row["clusters"], "<i4")), pa.array(np.frombuffer(row["distances"], "<i8"))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    keyed = blocks.filter("ids is not null").select("chunk", "ids").join(_assigned(blocks, slices), "chunk")
    result = cut_lineage(keyed.mapInArrow(spread, schema))
    inertia = {r.cluster: r.d for r in result.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    final = np.concatenate(slices, axis=1)
    of_cluster = [
        (c, inertia.get(c, 0), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(final.tolist())
    ]
    table = df.sparkSession.createDataFrame(of_cluster, "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = result.join(F.broadcast(table), "cluster")  # one row a cluster
    return joined.select(
        F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia",
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256",
    )


def lloyd_sql(dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL over ``embeddings``, one table expression a step."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM
        (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {clusters}))""",
    ]
    distance = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i])))::BIGINT"
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(struct_pack(d := d, c := c)) AS best FROM
        (SELECT v.vec_id, v.x, k.c, {distance} AS d FROM v, c{r} k) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT c, list(q ORDER BY i) AS x FROM
            (SELECT best.c AS c, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS q
             FROM (SELECT best, x, unnest(range(1, {dimensions} + 1)) AS i FROM a{r}) GROUP BY best.c, i) GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{r} k LEFT JOIN m{r} m ON m.c = k.c)")
    return f"""WITH {", ".join(parts)}
    SELECT a.vec_id, a.best.c::INT AS cluster, a.best.d AS distance,
           (sum(a.best.d) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia, (sum(a.best.d) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(k.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} k ON k.c = a.best.c"""
