"""Language identification by the nearest of several centroids a language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.common import mix64, slices, texts_of, unused_name
from weftlink.session import cut_lineage

#: Hashed n-grams of one to three characters; a bound on the size of the model, not on what it reads.
DIMENSIONS = 4096
#: Labelled rows of a language that its centroids are fitted on, at most.
SAMPLE = 1000
CENTROIDS = 4
#: A text is rejected if its cosine is under this part of the low quantile of the cosines that its language was fitted on.
REACH, LOW = 0.5, 0.01
#: Cells that trigrams are told apart by when it is asked whether they are known, as a power of two; a trigram is known
#: if at least two training texts of a language, and this share of them, hold it.
CELL_BITS, KNOWN_SHARE = 24, 0.001
#: A text is not rejected for unknown trigrams if this share of them is known, nor for what chance does in a short one.
ENOUGH, CHANCE = 0.75, 2.0
#: What one more unit of cosine multiplies the odds of a language by, as an exponent of e.
SHARPNESS = 40.0
SLICE_BYTES = 1 << 19
#: Trigrams that a task counts before it passes the counts on; it changes no result.
HELD_TRIGRAMS = 1 << 22
NONE = "und"

_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case with a blank for all else, and the text that each place belongs to."""
    low = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(_LETTER[points], points, np.uint32(32)).astype(np.uint64), np.repeat(np.arange(len(low)), sizes)


def _grams(x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spread 64-bit number for each n-gram inside a text, and its text; blanks alone say nothing."""
    last = max(0, len(x) - n + 1)
    code = np.zeros(last, dtype=np.uint64)
    for k in range(n):
        code = (code << np.uint64(21)) | x[k : k + last]
    inside = owner[:last] == owner[n - 1 :]
    inside &= code != np.uint64(sum(32 << (21 * k) for k in range(n)))
    return mix64(code[inside] + np.uint64(n)), owner[:last][inside]


def gram_counts(texts: list[str]) -> np.ndarray:
    """How often each hashed n-gram occurs in each text, in lower case, with a blank for all that is no letter."""
    return _counts_and_trigrams(texts)[0]


def _counts_and_trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of ``gram_counts``, and the cell and the text of each trigram."""
    x, owner = _points(texts)
    places = []
    for n in (1, 2, 3):
        code, at = _grams(x, owner, n)
        places.append(at * DIMENSIONS + (code >> np.uint64(64 - 12)).astype(np.int64))
    flat = np.bincount(np.concatenate(places), minlength=len(texts) * DIMENSIONS)
    return flat.reshape(len(texts), DIMENSIONS), (code >> np.uint64(64 - CELL_BITS)).astype(np.int64), at


def known_shares(cells: np.ndarray, at: np.ndarray, n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of known trigrams of each of n texts, and how many trigrams it has; ``known`` has a bit a cell."""
    size = np.bincount(at, minlength=n)
    hit = known[cells >> 3] >> (cells & 7).astype(np.uint8) & 1
    return np.bincount(at, weights=hit, minlength=n) / np.maximum(size, 1), size


def _reach(size: np.ndarray, usual: np.ndarray | float) -> np.ndarray:
    """What part of the usual cosine a text of so many trigrams can have: it grows with the root of a short text."""
    return np.sqrt(np.minimum(1, size / usual))


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + ln count) * idf, scaled to length one; a row of zeros stays."""
    x = np.zeros(counts.shape, dtype=np.float32)
    at = counts > 0
    x[at] = 1 + np.log(counts[at])
    x *= idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from rows at even places: centroids of length one, and the rows' cosine to the nearest."""
    centroids = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))]
    for _ in range(rounds):
        of = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[of == j].sum(axis=0) if (of == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids, (x @ centroids.T).max(axis=1)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    #: By language: the low quantile of the cosines, the usual number of trigrams, the share of them that must be known.
    low: np.ndarray
    usual: np.ndarray
    least_known: np.ndarray
    idf: np.ndarray
    known: np.ndarray

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """``lang_pred, score, distance, rejected`` of each text.

        ``score`` is the share of the language's odds among all; ``distance`` is one less the cosine to its nearest
        centroid. Rejected are texts without a letter, which are ``und`` with score 0, those beyond the reach
        of their language, and those with too many trigrams that no language has, however long they are.
        """
        out = pd.DataFrame({"lang_pred": [NONE] * len(texts), "score": 0.0, "distance": 1.0, "rejected": True})
        rows = np.array([i for i, t in enumerate(texts) if has_letter(t)], dtype=np.int64)
        if len(rows) and self.languages:
            counts, cells, at = _counts_and_trigrams([texts[i] for i in rows])
            cosine = unit_vectors(counts, self.idf) @ self.centroids.T
            by_language = np.stack([cosine[:, self.owner == j].max(axis=1) for j in range(len(self.languages))], axis=1)
            best = by_language.argmax(axis=1)
            top = by_language.max(axis=1)
            odds = np.exp(SHARPNESS * (by_language - top[:, None]).astype(np.float64))
            out.loc[rows, "lang_pred"] = np.array(self.languages, dtype=object)[best]
            out.loc[rows, "score"] = 1 / odds.sum(axis=1)
            out.loc[rows, "distance"] = np.clip(1 - top.astype(np.float64), 0, 1)
            share, size = known_shares(cells, at, len(rows), self.known)
            far = top < REACH * self.low[best] * _reach(size, self.usual[best])
            out.loc[rows, "rejected"] = far | (share + CHANCE / np.sqrt(np.maximum(size, 1)) < self.least_known[best])
        return out


def _document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many hold each n-gram; summed in tasks, then by groups of tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros(DIMENSIONS, dtype=np.int64)
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                n += len(rows)
                held += (gram_counts(texts_of(rows, "text")) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([held], pa.list_(pa.int64()))], names=["n", "held"])

    def add(rows: pa.Table) -> pa.Table:
        held = sum(np.array(h) for h in rows["held"].to_pylist())
        return pa.table({"n": [sum(rows["n"].to_pylist())], "held": pa.array([held], pa.list_(pa.int64()))})

    schema = "n long, held array<long>"
    parts = texts.select("text").mapInArrow(count, schema)
    sums = parts.withColumn("g", F.pmod(F.xxhash64("held"), F.lit(16))).groupBy("g").applyInArrow(add, schema).collect()
    return sum(r["n"] for r in sums), sum((np.array(r["held"]) for r in sums), np.zeros(DIMENSIONS, dtype=np.int64))


def _known_trigrams(rows: DataFrame) -> np.ndarray:
    """A bit for each cell with a trigram that enough texts of some language hold, counted over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        texts_seen: Counter = Counter()
        keys, held = [], 0
        sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (sums[0][:0], sums[1][:0])
            both, where = np.unique(np.concatenate([sums[0], new]), return_inverse=True)
            return both, np.bincount(where, weights=np.concatenate([sums[1], n]), minlength=len(both)).astype(np.int64)

        def found() -> pa.RecordBatch:
            names = np.array(list(numbers), dtype=object)
            langs = np.append(names[sums[0] >> CELL_BITS], list(texts_seen))
            cells = np.append(sums[0] & ((1 << CELL_BITS) - 1), np.full(len(texts_seen), -1))
            n = np.append(sums[1], np.array(list(texts_seen.values()), dtype=np.int64))
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cells, pa.int64()), pa.array(n, pa.int64())], names=["lang", "cell", "n"])

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                langs = part.column("lang").to_pylist()
                of = np.array([numbers.setdefault(v, len(numbers)) for v in langs], dtype=np.int64)
                texts_seen.update(langs)
                x, owner = _points(texts_of(part, "text"))
                code, at = _grams(x, owner, 3)
                # each trigram of a text once
                pairs = np.sort(at << CELL_BITS | (code >> np.uint64(64 - CELL_BITS)).astype(np.int64))
                pairs = pairs[np.diff(pairs, prepend=-1) != 0]
                keys.append(of[pairs >> CELL_BITS] << CELL_BITS | pairs & ((1 << CELL_BITS) - 1))
                held += len(pairs)
                if held > HELD_TRIGRAMS:
                    sums, keys, held = summed(), [], 0
                if len(sums[0]) > HELD_TRIGRAMS:
                    yield found()
                    sums = sums[0][:0], sums[1][:0]
                    texts_seen.clear()
        sums = summed()
        yield found()

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    sizes = counts.filter("cell = -1").select("lang", F.greatest(F.lit(2.0), F.lit(KNOWN_SHARE) * F.col("n")).alias("enough"))
    cells = counts.filter("cell >= 0 and n >= 2").join(F.broadcast(sizes), "lang").filter("n >= enough")
    # a byte of bits a row: as many rows as there are cells at most, a fixed number
    bits = cells.groupBy((F.col("cell") / 8).cast("long").alias("at")).agg(F.expr("bit_or(shiftleft(1, CAST(cell % 8 AS INT)))").alias("bits"))
    known = np.zeros(1 << (CELL_BITS - 3), dtype=np.uint8)
    made = bits.toPandas()
    known[made["at"].to_numpy(dtype=np.int64)] = made["bits"].to_numpy(dtype=np.uint8)
    return known


def fit_languages(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS
) -> LanguageModel:
    """Learn from rows where ``learn`` holds, with a language and a text that has a letter.

    The n-grams' document frequencies and the known trigrams count all these rows. The centroids of each language are fitted on ``sample``
    of its rows at most, those with the smallest hash of the key.
    """
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    n, held = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + held)).astype(np.float32) + 1
    known = _known_trigrams(rows)
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def fit(group: pa.Table) -> pa.Table:
        texts, parts, shares, sizes = group["text"].to_pylist(), [], [], []
        for a in range(0, len(texts), 100):
            counts, cells, at = _counts_and_trigrams(texts[a : a + 100])
            parts.append(unit_vectors(counts, idf))
            share, size = known_shares(cells, at, len(counts), sent.value)
            shares.append(share + CHANCE / np.sqrt(np.maximum(size, 1)))
            sizes.append(size)
        centroids, cosine = cluster(np.concatenate(parts), k)
        share, size = np.concatenate(shares), np.concatenate(sizes)
        usual = max(1.0, float(np.median(size)))
        low = float(np.quantile(cosine / np.maximum(_reach(size, usual), 1e-12), LOW))
        # twice as far from the middle as the low quantile
        least = min(ENOUGH, float(2 * np.quantile(share, LOW) - np.median(share)))
        m = len(centroids)
        return pa.table(
            {
                "lang": pa.array([group["lang"][0].as_py()] * m, pa.string()),
                "centroid": pa.array(list(centroids), pa.list_(pa.float32())),
                "low": pa.array([low] * m, pa.float64()),
                "usual": pa.array([usual] * m, pa.float64()),
                "least_known": pa.array([least] * m, pa.float64()),
            }
        )

    # which rows: found on the keys alone, so that no text is sorted
    first = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = rows.select("key", "lang").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample)
    fitted = rows.join(chosen.select("key", "lang"), ["key", "lang"], "left_semi").dropDuplicates(["key", "lang"])
    made = fitted.groupBy("lang").applyInArrow(fit, "lang string, centroid array<float>, low double, usual double, least_known double").collect()
    made.sort(key=lambda r: (r["lang"], r["centroid"]))
    of = {r["lang"]: r for r in made}
    languages = sorted(of)
    return LanguageModel(
        languages,
        np.array([languages.index(r["lang"]) for r in made]),
        np.array([r["centroid"] for r in made], dtype=np.float32).reshape(-1, DIMENSIONS),
        *(np.array([of[lang][name] for lang in languages], dtype=float) for name in ("low", "usual", "least_known")),
        idf,
        known,
    )


def language_of(text: Column | str, model: LanguageModel) -> Column:
    """``struct<lang_pred, score, distance, rejected>`` of a text column."""

    @F.pandas_udf("lang_pred string, score double, distance double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [None if t is None or t != t else t for t in texts]
            parts, start, held = [], 0, 0
            for i, t in enumerate(values, 1):
                held += len(t or "")
                if held > SLICE_BYTES or i == len(values) or i - start >= 1000:
                    parts.append(model.predict(values[start:i]))
                    start, held = i, 0
            yield pd.concat(parts, ignore_index=True)

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, distance, rejected``: a row for each row; other columns are not read."""
    return docs.select(key, language_of(F.col(text), model).alias("p")).select(key, "p.*")


def known_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    name = unused_name(docs, "language")
    return docs.withColumn(name, language_of(F.col(text), model)).filter(~F.col(name)["rejected"]).drop(name)
