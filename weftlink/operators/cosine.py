"""All-pairs cosine between definitions, reduced inside the tiles.

Input: one row per definition with ``id``, ``keyset`` and ``embedding``. Similarities are rounded to
``decimals`` places before they are compared, so equal values tie the same way on every engine and
in both directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from weftlink.plans.tiles import BLOCK_NUMBERS, Same, block_of, map_meetings, map_stripes, map_tiles, roomy_block

DECIMALS = 12
FINEST_BINS = 7
#: Sources whose products with a keyset's targets are made at once.
SLICE = 1024
#: Similarities that are made at once.
ROOM = 1 << 20
#: Links, or answers by keyset, that a block of sources may hold.
MOST_HELD = 4_000_000


def unit_rows(table: pa.Table) -> np.ndarray:
    """The embedding column as a matrix of unit rows; a zero vector stays zero."""
    vectors = table.column("embedding").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(vectors), -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def _similarities(left: pa.Table, right: pa.Table, decimals: int, clamp: bool) -> np.ndarray:
    a = unit_rows(left)
    sims = a @ (a if right is left else unit_rows(right)).T
    if right is left:  # one rounding for both directions
        sims = np.triu(sims) + np.triu(sims, 1).T
    if clamp:
        sims = np.clip(sims, -1.0, 1.0)
    return np.round(sims, decimals)


def _directions(tiles: Iterator, decimals: int, clamp: bool = False):
    """Each tile as (sources, targets, sims), once per direction."""
    for left, right in tiles:
        sims = _similarities(left, right, decimals, clamp)
        yield left, right, sims
        if right is not left:
            yield right, left, sims.T


def _strings(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _in_keyset_order(table: pa.Table) -> tuple[pa.Table, list[str], np.ndarray]:
    """Rows by keyset and id, the keysets' names and where each begins, so a keyset's targets are one run of columns."""
    ids, keysets = _strings(table, "id"), _strings(table, "keyset").astype(str)
    names, codes = np.unique(keysets, return_inverse=True)
    order = np.lexsort((np.argsort(np.argsort(ids, kind="stable"), kind="stable"), codes))
    begins = np.searchsorted(codes[order], np.arange(len(names)))
    return table.take(pa.array(order)).combine_chunks(), names.tolist(), begins


def _top_places(values: np.ndarray, top_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``top_n`` highest positive values of each row, ties by column."""
    fit = np.where((values > 0) & (values < np.inf), values, -np.inf)
    width = fit.shape[1]
    least = np.partition(fit, width - top_n, axis=1)[:, width - top_n] if width > top_n else np.full(len(fit), -np.inf)
    row, column = np.nonzero((fit >= least[:, None]) & (fit > 0))
    order = np.lexsort((column, -fit[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < top_n], column[place < top_n]


def _vectors(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("string").alias("id"), F.col("keyset").cast("string").alias("keyset"), "embedding")


def cosine_edges(df: DataFrame, decimals: int = DECIMALS, block_rows: int = 1024) -> DataFrame:
    """Every ordered pair except self pairs: ``id_a, id_b, sim, keyset_a, keyset_b``.

    The result has n(n-1) rows by definition. Use it where that table is wanted, such as a figure's
    definitions; the reductions below answer the same questions without it.
    """
    rows = _vectors(df)

    def kernel(tiles):
        for sources, targets, sims in _directions(tiles, decimals):
            ids_a, ids_b = _strings(sources, "id"), _strings(targets, "id")
            keep = np.flatnonzero((ids_a[:, None] != ids_b[None, :]).ravel())
            a, b = np.divmod(keep, len(ids_b))
            yield pa.RecordBatch.from_arrays(
                [
                    sources.column("id").combine_chunks().take(pa.array(a)),
                    targets.column("id").combine_chunks().take(pa.array(b)),
                    pa.array(sims.ravel()[keep]),
                    sources.column("keyset").combine_chunks().take(pa.array(a)),
                    targets.column("keyset").combine_chunks().take(pa.array(b)),
                ],
                names=["id_a", "id_b", "sim", "keyset_a", "keyset_b"],
            )

    schema = "id_a string, id_b string, sim double, keyset_a string, keyset_b string"
    return map_tiles(rows, "id", kernel, schema, rows.count(), block_rows)


def _extent(df: DataFrame) -> tuple[int, int]:
    """Rows and the width of the widest vector."""
    n, width = df.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return n, width or 1


class _Profile:
    """Number, sum, lowest and highest of a block's rounded similarities into each keyset while targets pass.

    Sums are made of whole numbers, so no order of the targets changes them."""

    def __init__(self, sources: pa.Table, decimals: int, self_pairs: bool) -> None:
        self.scale, self.decimals, self.self_pairs = 10.0**decimals, decimals, self_pairs
        self.units, self.ids = unit_rows(sources), sources.column("id").combine_chunks()
        self.same = None if self_pairs else Same(sources.column("id"))
        self.names: dict[str, int] = {}
        self.most = max(1, MOST_HELD // len(self.units))
        self.fold = (np.add, np.add, np.fmin, np.maximum)  # missing numbers count as the highest, as in SQL
        self.held = [np.zeros((len(self.units), 0)) for _ in self.fold]

    def meet(self, targets: pa.Table) -> Iterator[pa.RecordBatch]:
        targets, names, begins = _in_keyset_order(targets)
        units = unit_rows(targets)
        ends = [*begins[1:].tolist(), len(units)]
        row, column = self.same.places(targets.column("id")) if self.same else (np.empty(0, int), np.empty(0, int))
        for k in range(0, len(names), self.most):
            if len(self.names.keys() | set(names[k : k + self.most])) > self.most:
                yield from self.take()
            part = slice(int(begins[k]), ends[min(k + self.most, len(names)) - 1])
            mine = (column >= part.start) & (column < part.stop)
            self._add(units[part], names[k : k + self.most], begins[k : k + self.most] - part.start, row[mine], column[mine] - part.start)

    def _add(self, units: np.ndarray, names: list[str], begins: np.ndarray, row: np.ndarray, column: np.ndarray) -> None:
        at = np.array([self.names.setdefault(name, len(self.names)) for name in names])
        more = len(self.names) - self.held[0].shape[1]
        if more > 0:
            for i, start in enumerate((0.0, 0.0, np.inf, -np.inf)):
                self.held[i] = np.concatenate([self.held[i], np.full((len(self.units), more), start)], axis=1)
        sizes = np.diff(begins, append=len(units)).astype(float)
        rows = max(16, ROOM // len(units))
        for low in range(0, len(self.units), rows):
            high = min(low + rows, len(self.units))
            sims = self.units[low:high] @ units.T
            if self.self_pairs:
                np.clip(sims, -1.0, 1.0, out=sims)
            sims *= self.scale
            np.rint(sims, out=sims)
            own = slice(*np.searchsorted(row, (low, high)))
            i, j = row[own] - low, column[own]
            number = np.tile(sizes, (high - low, 1))
            np.subtract.at(number, (i, np.searchsorted(begins, j, side="right") - 1), 1.0)
            found = [number]
            for fold, out in zip(self.fold[1:], (0.0, np.inf, -np.inf), strict=True):
                sims[i, j] = out
                found.append(fold.reduceat(sims, begins, axis=1))
            for fold, held, new in zip(self.fold, self.held, found, strict=True):
                held[low:high, at] = fold(held[low:high, at], new)

    def take(self) -> Iterator[pa.RecordBatch]:
        """What was held, given away: from here on it is as if no target had passed."""
        number, total, low, high = self.held
        for name, k in self.names.items():
            some = number[:, k] > 0
            yield pa.RecordBatch.from_arrays(
                [
                    self.ids.filter(pa.array(some)),
                    pa.array([name] * int(some.sum()), type=pa.string()),
                    pa.array(number[some, k].astype(np.int64)),
                    *(pa.array(x[some, k] / self.scale) for x in (total, low, high)),
                ],
                names=["id_a", "keyset_b", "n", "total", "low", "high"],
            )
        self.names, self.held = {}, [x[:, :0] for x in self.held]


def cosine_profile(
    df: DataFrame, decimals: int = DECIMALS, self_pairs: bool = False, block_rows: int | None = None
) -> DataFrame:
    """Per definition and target keyset: how many edges, their sum, lowest and highest.

    ``self_pairs`` adds the diagonal and clamps to [-1, 1], as the self-similarity figure does. A task holds a block of
    sources and their numbers so far while its targets pass.
    """
    rows = _vectors(df)
    n, width = _extent(rows)

    def kernel(sources, chunks):
        profile = _Profile(sources, decimals, self_pairs)
        for targets in chunks:
            yield from profile.meet(targets)
        yield from profile.take()

    schema = "id_a string, keyset_b string, n long, total double, low double, high double"
    block_rows = block_rows or max(1024, BLOCK_NUMBERS // width)
    partial = map_stripes(rows, rows, "id", kernel, schema, n, n, block_rows, small_answers=True)
    return partial.groupBy("id_a", "keyset_b").agg(
        F.sum("n").alias("n_edges"),
        F.sum("total").alias("sum_sim"),
        F.min("low").alias("min_sim"),
        F.max("high").alias("max_sim"),
    )


def best_links(candidates: DataFrame, value: str, top_n: int) -> DataFrame:
    """The ``top_n`` highest values per source and target keyset, ties by target id.

    Spark prunes to ``top_n`` rows per source before the shuffle, so a hot source costs no more.
    """
    order = Window.partitionBy("id_a", "keyset_b").orderBy(F.desc(value), F.asc("id_b"))
    return (
        candidates.withColumn("link_rank", F.row_number().over(order)).filter(F.col("link_rank") <= top_n)
    )


class _Best:
    """The best links of a block's sources into each keyset while targets pass, and the least value that still counts."""

    def __init__(self, sources: pa.Table, top_n: int, decimals: int) -> None:
        self.top_n, self.decimals = top_n, decimals
        self.units = _finite(unit_rows(sources))
        self.coarse = self.units.astype(np.float32)
        # what a product in single precision and rounding may be off
        self.slack = (self.units.shape[1] + 8) * 2.0**-23 + 10.0**-decimals
        self.same = Same(sources.column("id"))
        self.names: dict[str, int] = {}
        self.least = np.zeros((len(self.units), 0))
        self.held: list[pa.Table] = []
        self.rows = self.sorted_rows = 0

    def _column(self, name: str) -> int:
        at = self.names.setdefault(name, len(self.names))
        if at >= self.least.shape[1]:
            more = max(8, self.least.shape[1])
            self.least = np.concatenate([self.least, np.full((len(self.least), more), -np.inf)], axis=1)
        return at

    def meet(self, targets: pa.Table) -> None:
        targets, names, begins = _in_keyset_order(targets)
        units, ids = _finite(unit_rows(targets)), targets.column("id").combine_chunks()
        coarse = np.ascontiguousarray(units.astype(np.float32).T)
        row, column = self.same.places(targets.column("id"))
        for name, start, stop in zip(names, begins.tolist(), [*begins[1:].tolist(), len(units)], strict=True):
            at = self._column(name)
            part, mine = coarse[:, start:stop], (column >= start) & (column < stop)
            row_k, column_k = row[mine], column[mine] - start
            for low in range(0, len(self.units), SLICE):
                high = min(low + SLICE, len(self.units))
                sims = self.coarse[low:high] @ part
                own = slice(*np.searchsorted(row_k, (low, high)))
                sims[row_k[own] - low, column_k[own]] = -np.inf
                least = np.maximum(self.least[low:high, at], _nth_at_least(sims, self.top_n, self.least[low:high, at]))
                i, j = np.divmod(np.flatnonzero(sims >= (np.maximum(least, 0) - self.slack).astype(np.float32)[:, None]), stop - start)
                if not len(i):
                    continue
                value = np.round(np.einsum("ij,ij->i", self.units[i + low], units[j + start]), self.decimals)
                keep = (value > 0) & (value >= self.least[i + low, at]) & np.isfinite(sims[i, j])
                i, j, value = i[keep] + low, j[keep] + start, value[keep]
                keyset = pa.array(np.full(len(i), at))
                self.held.append(pa.table({"source": pa.array(i), "keyset": keyset, "sim": pa.array(value), "id": ids.take(pa.array(j))}))
                self.rows += len(i)
        if self.rows > 1.5 * self.sorted_rows + 100_000:
            self.sort()

    def sort(self) -> pa.Table:
        """Drops what is no longer among the best."""
        rows = pa.concat_tables(self.held).combine_chunks()
        rows = rows.sort_by([("source", "ascending"), ("keyset", "ascending"), ("sim", "descending"), ("id", "ascending")])
        source, keyset = rows.column("source").to_numpy(), rows.column("keyset").to_numpy()
        group = source * (len(self.names) + 1) + keyset
        place = np.arange(len(group)) - np.searchsorted(group, group)
        rows = rows.filter(pa.array(place < self.top_n))
        last = np.flatnonzero(place == self.top_n - 1)
        self.least[source[last], keyset[last]] = rows.column("sim").to_numpy()[np.flatnonzero(place[place < self.top_n] == self.top_n - 1)]
        self.held, self.rows, self.sorted_rows = [rows], rows.num_rows, rows.num_rows
        return rows

    def take(self) -> pa.Table | None:
        """The best so far, given away: from here on it is as if no target had passed."""
        rows = self.sort() if self.held else None
        self.held, self.rows, self.sorted_rows = [], 0, 0
        self.least[:] = -np.inf
        return rows


def _finite(units: np.ndarray) -> np.ndarray:
    """Rows that are not finite have no similarity; as zeros they have none that counts."""
    units[~np.isfinite(units).all(axis=1)] = 0.0
    return units


def _nth_at_least(sims: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """A value for each row that ``n`` of its values reach, or -inf: of groups' highest values the n-th. Rows whose least
    value is ``known`` need none."""
    out = np.full(len(sims), -np.inf)
    new = np.flatnonzero(known == -np.inf)
    width = sims.shape[1]
    if not len(new) or width < n:
        return out
    rows = sims if len(new) == len(sims) else sims[new]
    groups = min(width, 4 * n)
    cut = width // groups * groups
    most = rows[:, :cut].reshape(len(rows), cut // groups, groups).max(axis=1)
    out[new] = np.partition(most, groups - n, axis=1)[:, groups - n]
    return out


def cosine_top_links(df: DataFrame, top_n: int, decimals: int = DECIMALS, block_rows: int = 16384) -> DataFrame:
    """Strongest positive links of each definition into each keyset.

    A task holds a block of sources and their best links so far while its targets pass: products in single precision
    say which pairs may be among the best, and only those are made in double precision. A block with
    more than ``MOST_HELD`` links passes on what it has.
    """
    rows = _vectors(df)

    def kernel(sources, chunks):
        best = _Best(sources, top_n, decimals)
        ids, keysets = sources.column("id").combine_chunks(), sources.column("keyset").combine_chunks()

        def batches(found: pa.Table | None):
            names = pa.array(list(best.names), pa.string())
            for part in found.to_batches(65536) if found is not None else []:
                source = part.column("source")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(source), part.column("id"), part.column("sim"), keysets.take(source), names.take(part.column("keyset"))],
                    names=["id_a", "id_b", "sim", "keyset_a", "keyset_b"],
                )

        for targets in chunks:
            best.meet(targets)
            if best.sorted_rows > MOST_HELD or best.least.size > 8 * MOST_HELD:
                yield from batches(best.take())
                best.names, best.least = {}, best.least[:, :0]
        yield from batches(best.take())

    schema = "id_a string, id_b string, sim double, keyset_a string, keyset_b string"
    n = rows.count()
    return best_links(map_stripes(rows, rows, "id", kernel, schema, n, n, block_rows), "sim", top_n)


def cosine_histogram(df: DataFrame, decimals: int = 6, block_rows: int | None = None, places: int | None = None) -> DataFrame:
    """How many ordered pairs have each similarity: ``bin`` (value times 10^decimals) and ``n``.

    Values are rounded to ``places`` first, so a value that is compared with ``places`` decimals falls into the bin
    it was counted in. A task counts all its tiles in one fixed array and emits it once. Bins finer than
    ``FINEST_BINS`` would be one row a pair and are not made.
    """
    if decimals > FINEST_BINS:
        raise ValueError(f"bins of {decimals} decimals would list the pairs; use at most {FINEST_BINS}")
    rows = _vectors(df)
    n, width = _extent(rows)
    scale = 10**decimals

    def kernel(tiles):
        room = scale + scale // 100  # rounding may pass 1 by a hair
        held = np.zeros(2 * room + 1, dtype=np.int64)
        for left, right in tiles:
            diagonal = right is left
            a = unit_rows(left)
            b = a if diagonal else unit_rows(right)
            # a slice of sources meets a slice of targets at a time, a diagonal tile's those after them
            for low in range(0, len(a), SLICE):
                mine = a[low : low + SLICE]
                for start in range(low if diagonal else 0, len(b), 4 * SLICE):
                    sims = mine @ b[start : start + 4 * SLICE].T
                    bins = value_bins(sims, decimals, decimals if places is None else places)
                    if diagonal and start == low:
                        bins = bins[np.arange(start, start + bins.shape[1])[None, :] > np.arange(low, low + len(mine))[:, None]]
                    bins = bins.ravel()
                    bins += room
                    held += np.bincount(bins, minlength=len(held))
        filled = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(filled - room), pa.array(2 * held[filled])], names=["bin", "n"])

    block_rows = block_rows or roomy_block(n, width, rows.sparkSession.sparkContext.defaultParallelism)
    partial = map_tiles(rows, "id", kernel, "bin long, n long", n, block_rows)
    return partial.groupBy("bin").agg(F.sum("n").alias("n"))


def value_bins(sims: np.ndarray, decimals: int, places: int) -> np.ndarray:
    """Bins of values rounded to ``places`` first; changes ``sims``."""
    if places == decimals:  # one rounding makes both
        sims *= 10.0**decimals
        return np.rint(sims, out=sims).astype(np.int64)
    sims = np.round(sims, places) * 10**decimals
    return (np.sign(sims) * np.floor(np.abs(sims) + 0.5)).astype(np.int64)  # halves away from zero, as in SQL


def unit_vectors(df: DataFrame) -> DataFrame:
    """``embedding`` scaled to unit length in the JVM."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(squares)
    scaled = df.withColumn("_norm", F.when(norm == 0, F.lit(1.0)).otherwise(norm))
    return scaled.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") / F.col("_norm"))).drop(
        "_norm"
    )


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class Units:
    """Unit rows of vectors of any width, by row; a vector that is missing or has a missing number has none."""

    def __init__(self, table: pa.Table) -> None:
        vectors = table.column("embedding").combine_chunks()
        self.width = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()  # without those of missing vectors
        ends = np.cumsum(np.maximum(self.width, 0))
        gaps = np.searchsorted(ends, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), side="right")
        numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        self.at, self.of = np.zeros(len(self.width), np.int64), {}
        for width in np.unique(self.width[self.width >= 0]).tolist():
            mine = np.flatnonzero(self.width == width)
            matrix = numbers[(ends[mine] - width)[:, None] + np.arange(width)]
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            norms[norms == 0] = 1.0
            self.at[mine], self.of[width] = np.arange(len(mine)), matrix / norms[:, None]
        self.width[gaps] = -1

    def products(self, i: np.ndarray, other: Units, j: np.ndarray, decimals: int) -> pa.Array:
        """Rounded products of rows ``i`` with the other's rows ``j``, NULL where one has no vector or both differ in width."""
        value, fits = np.zeros(len(i)), (self.width[i] >= 0) & (self.width[i] == other.width[j])
        for width in np.unique(self.width[i[fits]]).tolist():
            mine = np.flatnonzero(fits & (self.width[i] == width))
            value[mine] = np.einsum("ij,ij->i", self.of[width][self.at[i[mine]]], other.of[width][other.at[j[mine]]])
        return pa.array(np.round(value, decimals), mask=~fits)


    def grid(self, rows: slice, other: Units, decimals: int) -> tuple[np.ndarray, np.ndarray]:
        """The rounded products of some rows with all of the other's, and which of them there are."""
        value = np.zeros((len(self.width[rows]), len(other.width)))
        for width in np.unique(self.width[rows][self.width[rows] >= 0]).tolist():
            i, j = np.flatnonzero(self.width[rows] == width), np.flatnonzero(other.width == width)
            if len(j):
                value[np.ix_(i, j)] = self.of[width][self.at[rows][i]] @ other.of[width][other.at[j]].T
        return np.round(value, decimals), (self.width[rows][:, None] >= 0) & (self.width[rows][:, None] == other.width[None, :])


def cosine_of_pairs(pairs: DataFrame, df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """``sim`` for given ``id_a, id_b`` rows, whose other columns stay.

    Vectors are dealt to blocks and copied to the tasks of pairs of blocks; a pair goes to one of them without any vector.
    """
    vectors = _vectors(df).select("id", "embedding").filter("id is not null")
    n, width = _extent(vectors)
    block_rows = roomy_block(n, width, df.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-n // block_rows))
    own = block_of("id", blocks)
    sides = [vectors.withColumn(f"block_{side}", own) for side in "ab"]
    keyed = pairs.withColumns({c: F.col(c).cast("string") for c in ("id_a", "id_b")}).filter("id_a is not null and id_b is not null")
    asking = keyed.withColumns({"block_a": block_of("id_a", blocks), "block_b": block_of("id_b", blocks)})
    fields = to_arrow_schema(StructType([*keyed.schema.fields, StructField("sim", DoubleType())]))

    def kernel(left, right, batches):
        places = Same(left.column("id")), Same(right.column("id"))
        one, two = Units(left), Units(right)
        for rows in batches:
            for start in range(0, rows.num_rows, ROOM // 16):
                part = pa.Table.from_batches([rows.slice(start, ROOM // 16)])
                i, pair = places[0].places(part.column("id_a"))
                j, other = places[1].places(part.column("id_b").take(pa.array(pair)))
                i, pair = i[other], pair[other]
                found = [part.column(f.name).take(pa.array(pair)).combine_chunks() for f in list(fields)[:-1]]
                yield from pa.table([*found, one.products(i, two, j, decimals)], schema=fields).to_batches()

    return map_meetings(*sides, asking, kernel, StructType([*keyed.schema.fields, StructField("sim", DoubleType())]), blocks, blocks)


def cosine_keyset_matrix(df: DataFrame) -> DataFrame:
    """Mean similarity over all ordered pairs of each keyset pair, self pairs left out.

    The sum of all dot products between two groups is the dot product of the groups' vector sums, so
    one pass over the vectors and a table with one row per keyset are enough. A task sums its own rows
    first and passes one row on for each keyset.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        for batch in batches:
            units = unit_rows(pa.Table.from_batches([batch]))
            codes, names = pd.factorize(batch.column("keyset").to_pandas(), use_na_sentinel=False)
            for code, name in enumerate(names):
                rows = units[codes == code]
                total = held.setdefault(name if isinstance(name, str) else None, [0.0, 0.0, 0])
                total[0], total[1], total[2] = total[0] + rows.sum(axis=0), total[1] + (rows * rows).sum(axis=0), total[2] + len(rows)
        vector = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.string()),
                pa.array([t[0] for t in held.values()], vector),
                pa.array([t[1] for t in held.values()], vector),
                pa.array([t[2] for t in held.values()], pa.int64()),
            ],
            names=["keyset", "x", "own", "n"],
        )

    parts = _vectors(df).mapInArrow(add_up, "keyset string, x array<double>, own array<double>, n long")
    placed = parts.select("keyset", "n", F.posexplode(F.arrays_zip("x", "own")).alias("pos", "v"))
    sums = placed.groupBy("keyset", "pos").agg(
        F.sum("v.x").alias("x"), F.sum("v.own").alias("own"), F.sum("n").alias("n")
    )
    a = sums.toDF("keyset_a", "pos", "xa", "own", "n_a")
    b = sums.select("keyset", "pos", "x", "n").toDF("keyset_b", "pos", "xb", "n_b")
    totals = (
        a.join(b, "pos")
        .groupBy("keyset_a", "keyset_b")
        .agg(
            F.sum(F.col("xa") * F.col("xb")).alias("total"),
            F.sum("own").alias("own"),
            F.max("n_a").alias("n_a"),
            F.max("n_b").alias("n_b"),
        )
    )
    same = F.col("keyset_a") == F.col("keyset_b")
    pairs = F.col("n_a") * F.col("n_b") - F.when(same, F.col("n_a")).otherwise(0)
    total = F.col("total") - F.when(same, F.col("own")).otherwise(0.0)
    return (
        totals.withColumn("n_pairs", pairs)
        .filter(F.col("n_pairs") > 0)
        .select("keyset_a", "keyset_b", (total / F.col("n_pairs")).alias("mean_value"), "n_pairs")
    )
