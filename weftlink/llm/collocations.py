"""Phrases that occur together more often than their parts explain, counted by an FM-index for each shard."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.common import full_uri, mix64, slices
from weftlink.llm.word_index import Found, WordIndex
from weftlink.session import cut_lineage, scratch_path

#: Longest phrase, fewest occurrences, percent of occurrences inside a longer phrase that drop a phrase, rows a language.
WORDS, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Words of one language in a shard, and words that a task keeps waiting for all languages together.
SHARD_WORDS, WAITING = 1 << 20, 1 << 22
SLICE_BYTES = 1 << 20
#: Bits for each frequent phrase in the filter that the next length is enumerated with, and the most bits of all.
FILTER_BITS, FILTER_MOST = 16, 1 << 27
#: Groups in which a language's rows are ranked first.
SALTS = 32
#: Phrases that a task hands over at a time.
HANDED = 1 << 15
#: Shards that a task enumerates, about.
SHARDS_IN_TASK = 4

_BYTE = np.random.default_rng(13).integers(1, 2**64, 256, dtype=np.uint64)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# fixed values: what ends a piece, and what stands between words
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_KIND[list(b" \t")] = 1


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends, hashes and piece numbers of the words in lower-case bytes."""
    kind = _KIND[data]
    inner = np.concatenate([[0], (kind == 0).view(np.int8), [0]])
    change = np.diff(inner)
    begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if not len(begins):
        nothing = np.empty(0, dtype=np.int64)
        return nothing, nothing, nothing.astype(np.uint64), nothing
    letters = np.flatnonzero(kind == 0)
    sizes = ends - begins
    first = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), _FACTOR))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    hashes = mix64(np.add.reduceat(_BYTE[data[letters]] * powers[place], first) + sizes.astype(np.uint64))
    return begins, ends, hashes, np.cumsum(kind == 2)[begins]


def _lowered(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.lower(), dtype=np.uint8)  # bytes.lower knows only A-Z


def _seed(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()) + 1)


def phrase_hash(hashes: np.ndarray, lang: str) -> np.ndarray:
    """One hash for each row of word hashes."""
    out = np.full(len(hashes), _seed(lang))
    for column in hashes.T:
        out = mix64(out * _STEP + column)
    return out


class _Shards:
    """Words of a task's texts by language, given out as shards: dictionary, counts and both transforms."""

    def __init__(self, shard_words: int) -> None:
        self.limit = shard_words
        self.waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.known: dict[str, dict[int, bytes]] = {}
        self.sizes: dict[str, int] = {}

    def add(self, lang: str, raw: bytes) -> Iterator[tuple]:
        data = _lowered(raw)
        begins, ends, hashes, pieces = words_of(data)
        if not len(begins):
            return
        different, at = np.unique(hashes, return_index=True)
        known, text = self.known.setdefault(lang, {}), data.tobytes()
        for h, a, b in zip(different.tolist(), begins[at].tolist(), ends[at].tolist(), strict=True):
            if h not in known:
                known[h] = text[a:b]
        self.waiting.setdefault(lang, []).append((hashes, np.append(pieces[1:] != pieces[:-1], True)))
        self.sizes[lang] = self.sizes.get(lang, 0) + len(hashes)
        if self.sizes[lang] >= self.limit:
            yield self.give(lang)
        while sum(self.sizes.values()) > max(WAITING, self.limit):
            yield self.give(max(self.sizes, key=self.sizes.__getitem__))

    def give(self, lang: str) -> tuple:
        hashes, last = (np.concatenate(x) for x in zip(*self.waiting.pop(lang), strict=True))
        known = self.known.pop(lang)
        n = self.sizes.pop(lang)
        different, ids = np.unique(hashes, return_inverse=True)
        seq = np.zeros(n + int(last.sum()), dtype=np.int64)
        seq[np.arange(n) + np.cumsum(last) - last] = ids + 1
        index = WordIndex.build(seq)
        names = b"\n".join([known[h] for h in different.tolist()])
        return lang, n, names, index.counts.astype("<i4").tobytes(), index.forward.bwt.tobytes(), index.backward.bwt.tobytes()


PARTS = ("names", "counts", "forward", "backward")


def shards(docs: DataFrame, root: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, n, file, ends`` of ``lang, text``: FM-indexes made where the texts are read, each a file under ``root``.

    A file holds dictionary, counts and both transforms one after another; ``ends`` are where they end. Tasks write the files
    through Arrow's file systems under names of their own, and only those of finished attempts become rows of the table that
    this must be stored as. So an index, megabytes in one piece, never passes through Spark's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Shards(shard_words)
        fs, folder = pafs.FileSystem.from_uri(root)

        def stored(shard: tuple) -> pa.RecordBatch:
            lang, n, *parts = shard
            file = f"{folder}/shard-{uuid.uuid4().hex}.bin"
            with fs.open_output_stream(file) as out:
                for part in parts:
                    out.write(part)
            ends = np.cumsum(list(map(len, parts))).tolist()
            arrays = [pa.array([lang]), pa.array([n]), pa.array([file]), pa.array([ends], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "n", "file", "ends"])

        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                langs = rows.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    texts = rows.column("text").filter(pc.equal(langs, lang)).cast(pa.binary()).to_pylist()
                    yield from map(stored, made.add(lang, b"\n".join(texts)))
        for lang in list(made.waiting):
            yield stored(made.give(lang))

    return docs.mapInArrow(run, "lang string, n long, file string, ends array<long>")


def _read_parts(fs: pafs.FileSystem, file: str, ends: list[int], wanted: list[str]) -> dict[str, bytes]:
    with fs.open_input_file(file) as data:
        starts = [0, *ends[:-1]]
        spans = zip(PARTS, starts, ends, strict=True)
        return {part: data.read_at(end - start, start) for part, start, end in spans if part in wanted}


class PhraseFilter:
    """A table of bits for the phrases of one length that are frequent; others pass by chance only."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.size = bits, len(bits) * 64

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % np.uint64(self.size)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def phrase_filter(frequent: DataFrame) -> PhraseFilter:
    """The filter of ``lang, phrase``; its size follows the number of phrases up to 16 MB, whatever their number."""
    n = frequent.count()
    size = 1 << min(max(16, int(np.ceil(np.log2(max(n, 1) * FILTER_BITS)))), FILTER_MOST.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                phrases = batch.column("phrase").filter(pc.equal(batch.column("lang"), lang)).cast(pa.binary()).to_pylist()
                hashes = words_of(np.frombuffer(b"\n".join(phrases), dtype=np.uint8))[2]
                place = phrase_hash(hashes.reshape(len(phrases), -1), lang) % np.uint64(size)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64))], names=["at"])

    places = frequent.select("lang", "phrase").mapInArrow(run, "at long")
    lanes = places.groupBy(F.shiftright("at", 6).alias("lane")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    rows = lanes.toArrow()
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[rows["lane"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return PhraseFilter(bits)


def enumerated(index: WordIndex, length: int, likely: Callable[[np.ndarray], np.ndarray], extensions: bool) -> Found:
    """The phrases of so many words all whose shorter parts are likely, by extension to the right, then to the left.

    Intervals that no further step needs are left out, unless ``extensions`` are wanted in the end.
    """
    found = index.single()
    for n in range(2, length + 1):
        found = found.keep(likely(found.words))
        if n == 2:
            found = index.right(found, extensions)
            found = found.keep(likely(found.words[:, 1:]))
        else:
            found = index.left(found, extensions or n < length)
            found = found.keep(likely(found.words[:, :-1]))
    return found


def _counted(indexed: DataFrame, root: str, length: int, filters: dict[int, PhraseFilter], least: int, extensions: bool) -> DataFrame:
    """``lang, phrase, n_words, f`` (and ``goes_left, goes_right``) of the phrases of so many words that occur often enough."""
    sent = {k: indexed.sparkSession.sparkContext.broadcast(f) for k, f in filters.items()}
    columns = ["f", "goes_left", "goes_right"] if extensions else ["f"]

    needed = ["names", "counts"]
    if extensions or length > 1:
        needed += ["backward"] if length == 2 and not extensions else ["forward", "backward"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                lang, cells = row["lang"], _read_parts(fs, row["file"], row["ends"], needed)
                named = pa.array(cells["names"].split(b"\n"), pa.binary())
                hashes = words_of(np.frombuffer(cells["names"], dtype=np.uint8))[2] if filters else None
                counts = np.frombuffer(cells["counts"], dtype="<i4").astype(np.int64)
                # single words are counted without the transforms
                ways = [np.frombuffer(cells.get(d, b""), dtype="<i4") for d in ("forward", "backward")]
                index = WordIndex(counts, *ways)

                def likely(words: np.ndarray, lang: str = lang, hashes: np.ndarray | None = hashes) -> np.ndarray:
                    return sent[words.shape[1]].value.passes(phrase_hash(hashes[words - 1], lang))

                found = enumerated(index, length, likely, extensions)
                for a in range(0, len(found.count), HANDED):
                    some = found.keep(np.s_[a : a + HANDED])
                    parts = [named.take(pa.array(c - 1)) for c in some.words.T]
                    phrase = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
                    numbers = [some.count, *(index.goes_on(some) if extensions else ())]
                    arrays = [pa.array([lang] * len(phrase), pa.string()), phrase, *map(pa.array, numbers)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", *columns])

    rows = indexed.select("lang", "file", "ends").mapInArrow(run, "lang string, phrase string, " + ", ".join(f"{c} long" for c in columns))
    # a shard has added up its own; adding up a task's shards before the shuffle would hold them all and save little
    sums = rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(*[F.sum(c).alias(c) for c in columns])
    return cut_lineage(sums.filter(F.col("f") >= least).withColumn("n_words", F.lit(length)))


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    words: int = WORDS,
    least: int = LEAST,
    shard_words: int = SHARD_WORDS,
    extensions: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``words`` words that occur ``least`` times or more, and the number of words of each language.

    The first table is ``lang, phrase, f, goes_left, goes_right, n_words``: occurrences, and how many of them have
    another word to the left and to the right in their piece (without ``extensions`` they are left out). The second is
    ``lang, n``.
    Lengths are counted one after another: a phrase can only be frequent if its parts are, so each shard enumerates
    those that pass the filter of the frequent parts. The filter lets some others pass, which are then counted and left out.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    root = full_uri(spark, scratch_path(spark, "word-index"))
    fs, folder = pafs.FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    indexed = cut_lineage(shards(rows, root, shard_words))
    dealt = indexed.repartition(max(1, -(-indexed.count() // SHARDS_IN_TASK)), "file")
    tables, filters = [], {}
    for length in range(1, words + 1):
        tables.append(_counted(dealt, root, length, filters, least, extensions))
        if length < words:
            filters[length] = phrase_filter(tables[-1])
    every = tables[0]
    for table in tables[1:]:
        every = every.union(table)
    return every, indexed.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    words: int = WORDS,
    least: int = LEAST,
    inside: int = INSIDE,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and into words at blanks and tabs. A phrase
    of 2 to ``words`` words with a = f(phrase) >= ``least`` is a candidate; for each cut into two parts that occur l and r
    times its score is floor(1000000 a a / (l r)), and the lowest counts (ties: the shorter first part). A candidate
    inside a longer one that has ``inside`` percent of its occurrences or more is dropped. n is the language's number of words.
    Decimals of 38 digits hold the products exactly for up to 10^16 occurrences.

    A null language counts as ``und``, a null text as empty; rows that repeat count as often as they occur. Ties in the
    order go by a, then by the phrase's bytes. Other columns are not read. An empty table gives no rows.
    """
    counted, totals = phrase_counts(docs, text, lang, words, least, shard_words, extensions=False)
    candidates = counted.filter("n_words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    parts = counted.select("lang", "phrase", "f")
    longer = candidates.filter("n_words > 2").select("lang", "a", "w", "n_words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m"))
    longer = longer.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)).alias("at"))
    longer = longer.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("around"))
    left = candidates.join(longer, ["lang", "phrase"], "left").filter(
        F.col("around").isNull() | (100 * F.col("around") < inside * F.col("a"))
    )
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.withColumn("head", F.array_join(F.slice("w", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("tail", F.array_join(F.slice("w", F.col("k") + 1, F.col("n_words") - F.col("k")), " "))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    exact = "cast(cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000 as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0)) as long)"
    scored = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # ranked in salted groups first, so that the last ranking of a language sees a bounded number of rows
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def collocations_sql(least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> str:
    """The same for phrases of two and three words in DuckDB's SQL over ``documents``."""
    return rf"""WITH pieces AS (
        SELECT lang, row_number() OVER () AS p, words FROM (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \t]+') AS words FROM (
                SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
                FROM documents)) WHERE len(words) > 0),
    w AS MATERIALIZED (SELECT lang, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces)),
    n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
    f AS MATERIALIZED (
        SELECT lang, 1 AS m, a AS phrase, count(*) AS f FROM w GROUP BY lang, a
        UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM w WHERE b IS NOT NULL GROUP BY lang, a, b
        UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM w WHERE b IS NOT NULL AND c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= {least}),
    candidates AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= {least}),
    around AS (SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM candidates WHERE m = 3
        UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM candidates WHERE m = 3) GROUP BY lang, phrase),
    kept AS (SELECT c.* FROM candidates c LEFT JOIN around o ON o.lang = c.lang AND o.phrase = c.phrase
        WHERE o.a IS NULL OR 100 * o.a < {inside} * c.a),
    cuts AS (SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM kept
        UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE m = 3),
    scored AS (SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r,
            ((c.a::HUGEINT * c.a * 1000000) // (h.f::HUGEINT * t.f))::BIGINT AS score
        FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
    lowest AS (SELECT lang, phrase, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS cut FROM scored GROUP BY lang, phrase, a),
    ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank, phrase, a,
            cut.l AS l, cut.r AS r, cut.score AS score FROM lowest)
    SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= {top}"""
