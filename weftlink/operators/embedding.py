"""Texts to embed, backends, and the incremental embedding step."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.html import clean_abstract, clean_title
from weftlink.functions.text import text_hash
from weftlink.operators.checks import require_columns, require_same_count
from weftlink.session import cut_lineage
from weftlink.sources.parquet import NO_VALUE, drop_partitions

# ---- fixed values -------------------------------------------------------------------------
SOURCES = ("corpus_chapter", "corpus", "keypaper")
DEFAULT_SEPARATOR = "[SEP]"
DEFAULT_TITLE_CAP = 200
DEFAULT_REQUEST_SIZE = 32
# -------------------------------------------------------------------------------------------

Preprocessor = Callable[[DataFrame], DataFrame]
EMBEDDING_SCHEMA = (
    "id string, text_hash string, provider string, model_id string, created_at string, text string,"
    " title_clean string, abstract_clean string, embedding array<double>"
)


# ---- texts --------------------------------------------------------------------------------
def cleaned(df: DataFrame) -> DataFrame:
    require_columns(df, ["id", "title", "abstract"])
    parts = {"title_clean": clean_title(F.col("title")), "abstract_clean": clean_abstract(F.col("abstract"))}
    # passed on as a generated row: a filter on the parts would else be pushed below them and clean every text again
    rest = [c for c in df.columns if c not in parts]
    return df.withColumns(parts).select(*rest, F.inline(F.array(F.struct(*parts))))


def _texts(df: DataFrame, text) -> DataFrame:
    return df.select("id", "title_clean", "abstract_clean", text.alias("text")).withColumn(
        "text_hash", text_hash(F.col("text"))
    )


def title_text(df: DataFrame) -> DataFrame:
    return _texts(cleaned(df).filter("title_clean is not null"), F.col("title_clean"))


def abstract_text(df: DataFrame) -> DataFrame:
    return _texts(cleaned(df).filter("abstract_clean is not null"), F.col("abstract_clean"))


def title_abstract_text(
    df: DataFrame, separator: str | None = DEFAULT_SEPARATOR, title_cap: int | None = DEFAULT_TITLE_CAP
) -> DataFrame:
    """``title separator abstract``; an empty separator leaves two blanks. Rows need both parts."""
    rows = cleaned(df).filter("title_clean is not null and abstract_clean is not null")
    title = F.substring("title_clean", 1, title_cap) if title_cap else F.col("title_clean")
    return _texts(rows, F.concat(title, F.lit(f" {separator or ''} "), F.col("abstract_clean")))


def variant_preprocessor(variant: str, separator: str | None = None, title_cap: int | None = None) -> Preprocessor:
    """The text builder of a variant name."""
    known: dict[str, Preprocessor] = {
        "title": title_text,
        "abstract": abstract_text,
        "title_abstract": lambda df: title_abstract_text(df, separator, title_cap),
    }
    if variant not in known:
        raise ValueError(f"unknown variant: {variant}")
    return known[variant]


def expected_rows(df: DataFrame, preprocessor: Preprocessor) -> int:
    return preprocessor(df).count()


# ---- backends -----------------------------------------------------------------------------
class Backend(Protocol):
    provider: str
    model: str
    request_size: int
    concurrency: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashBackend:
    """Deterministic vectors from the md5 of a text, for tests and dry runs."""

    model: str = "md5"
    width: int = 8
    provider: str = "hash"
    request_size: int = 512
    concurrency: int = 1

    def embed(self, texts: list[str]) -> list[list[float]]:
        digests = (hashlib.md5(t.encode()).hexdigest() for t in texts)
        return [[int(d[2 * i : 2 * i + 2], 16) / 255 for i in range(self.width)] for d in digests]


@dataclass(frozen=True)
class HttpBackend:
    """A text-embeddings server: POST ``{"inputs": [...]}`` to ``/embed``.

    In-flight requests are at most running tasks x ``concurrency``.
    """

    host: str
    port: int
    model: str
    scheme: str = "http"
    token: str | None = None
    request_size: int = DEFAULT_REQUEST_SIZE
    concurrency: int = 1
    retries: int = 3
    timeout: float = 120.0
    provider: str = "tei"

    def _ask(self, what: str, body: bytes | None = None):
        headers = {"Content-Type": "application/json"}
        if self.token:
            headers["Authorization"] = f"Bearer {self.token}"
        request = urllib.request.Request(f"{self.scheme}://{self.host}:{self.port}/{what}", body, headers)
        for attempt in range(self.retries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.loads(answer.read())
            except OSError:
                if attempt + 1 == self.retries:
                    raise
                time.sleep(2**attempt)
        raise AssertionError("unreachable")

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._ask("embed", json.dumps({"inputs": texts}).encode())

    def as_served(self) -> HttpBackend:
        """This backend under the model that the server says it runs, with no more texts a request than it takes.

        Vectors are kept by model, so a server with another model than the configured one does not pass for it.
        """
        info = self._ask("info")
        most = info.get("max_client_batch_size")
        size = min(self.request_size, int(most)) if most else self.request_size
        return replace(self, model=info.get("model_id") or self.model, request_size=size)


def http_backend(cfg: dict, token: str | None = None) -> HttpBackend:
    return HttpBackend(
        host=cfg["host"],
        port=int(cfg["port"]),
        model=cfg["model"],
        scheme=cfg.get("scheme") or "http",
        token=token,
        request_size=int(cfg.get("max_batch_size") or DEFAULT_REQUEST_SIZE),
        concurrency=int(cfg.get("concurrency") or 1),
    )


# ---- embedding ----------------------------------------------------------------------------
def embed_texts(texts: DataFrame, backend: Backend, save_text: bool = True) -> DataFrame:
    """Vectors for prepared texts. Each task streams its batches and keeps ``concurrency`` requests open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = backend.request_size
        with ThreadPoolExecutor(max_workers=backend.concurrency) as pool:
            for rows in batches:
                values = rows["text"].fillna("").tolist()
                requests = [values[i : i + size] for i in range(0, len(values), size)]
                vectors = [v for part in pool.map(backend.embed, requests) for v in part]
                yield pd.DataFrame(
                    {
                        "id": [None if pd.isna(i) else str(i) for i in rows["id"]],
                        "text_hash": rows["text_hash"],
                        "provider": backend.provider,
                        "model_id": backend.model,
                        "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
                        "text": rows["text"],
                        "title_clean": rows["title_clean"],
                        "abstract_clean": rows["abstract_clean"],
                        "embedding": vectors,
                    }
                )

    out = texts.select("id", "text_hash", "text", "title_clean", "abstract_clean").mapInPandas(run, EMBEDDING_SCHEMA)
    return out if save_text else out.drop("text")


def _made_by(embedded: DataFrame, backend: Backend | None) -> DataFrame:
    if backend is None:
        return embedded
    return embedded.filter((F.col("provider") == backend.provider) & (F.col("model_id") == backend.model))


def pending(texts: DataFrame, embedded: DataFrame, backend: Backend | None = None) -> DataFrame:
    """Texts without a vector for exactly this text: new definitions and edited ones.

    With a ``backend`` only vectors of its provider and model count, so a changed model embeds all anew.
    """
    return texts.join(_made_by(embedded, backend).select("id", "text_hash"), ["id", "text_hash"], "left_anti")


def current_vectors(embedded: DataFrame, texts: DataFrame, backend: Backend | None = None) -> DataFrame:
    """Stored vectors that belong to a current text, and to the backend's model where one is given."""
    return _made_by(embedded, backend).join(texts.select("id", "text_hash"), ["id", "text_hash"], "left_semi")


def leaf_path(root: str, config: str, source: str, variant: str, assessment: str | None = None) -> str:
    for name, value in (("config", config), ("source", source), ("variant", variant)):
        if not value:
            raise ValueError(f"{name} must be a non-empty string")
    if source not in SOURCES:
        raise ValueError(f"source must be one of {', '.join(SOURCES)}")
    path = f"{root}/config={config}/source={source}/variant={variant}"
    return f"{path}/assessment={assessment}" if assessment else path


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(EMBEDDING_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def embed_works(
    definitions: DataFrame,
    root: str,
    source: str,
    config: str,
    variant: str,
    backend: Backend,
    preprocessor: Preprocessor | None = None,
    assessment: str | None = None,
    dry_run: bool = False,
    save_text: bool = True,
) -> int:
    """Embed what is new under the leaf and return how many rows that were.

    A second run over the same input finds nothing pending. The leaf is checked after the write:
    every current text must have a vector. Repeats of an id are embedded once per distinct text.
    """
    spark = definitions.sparkSession
    path = leaf_path(root, config, source, variant, assessment)
    # cleaned once, read by the count, the write and the check
    texts = cut_lineage((preprocessor or variant_preprocessor(variant))(definitions))
    stored = _stored(spark, path)
    todo = texts if stored is None else pending(texts, stored, backend)
    todo = todo.dropDuplicates(["id", "text_hash"])
    n = todo.count()
    if dry_run or n == 0:
        return n
    embed_texts(todo, backend, save_text).write.mode("append").parquet(path)
    wanted = texts.select("id", "text_hash").distinct()
    require_same_count(wanted.count(), current_vectors(_stored(spark, path), texts, backend).select("id", "text_hash").distinct(), path)
    return n


# ---- leaves by partition ------------------------------------------------------------------
#: Beside the leaf's folders; names that begin so are no data to a scan.
MANIFEST = "_manifest"
MANIFEST_SCHEMA = "partition string, n long, mark string"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """``partition, n, mark``: what the last run left in each partition of a leaf."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def _contents(stored: DataFrame, by: str) -> DataFrame:
    """``partition, n, mark`` of the vectors as they are: rows, and a sum of hashes that no order changes."""
    mark = F.sum(F.xxhash64("id", "text_hash", "provider", "model_id", "embedding").cast("decimal(38,0)")).cast("string")
    return stored.groupBy(F.coalesce(F.col(by), F.lit(NO_VALUE)).alias("partition")).agg(F.count("*").alias("n"), mark.alias("mark"))


def damaged_partitions(spark: SparkSession, path: str, by: str) -> DataFrame:
    """``partition``s of a leaf that do not hold what its manifest says: rows lost, doubled or changed."""
    stored = _stored_by(spark, path, by)
    known = _manifest(spark, path)
    if stored is None:
        return known.select("partition")
    now = _contents(stored, by).toDF("partition", "n_now", "mark_now")
    same = (F.col("n") == F.col("n_now")) & (F.col("mark") == F.col("mark_now"))
    return known.join(now, "partition", "full").filter(~F.coalesce(same, F.lit(False))).select("partition")


def _stored_by(spark: SparkSession, path: str, by: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{EMBEDDING_SCHEMA}, {by} string").option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


#: Partitions that are asked for by name.
NAMED = 1000


def _rows_of(texts: DataFrame, todo: DataFrame) -> DataFrame:
    """The texts whose ``row`` is listed; those of other partitions are left out before the join where the partitions are few."""
    names = [r.partition for r in todo.select("partition").distinct().limit(NAMED + 1).collect()]
    near = texts.filter(F.col("partition").isin(names)) if len(names) <= NAMED else texts
    return near.join(todo.select("row"), "row", "left_semi")


def embed_partitions(
    works: DataFrame,
    by: str,
    root: str,
    source: str,
    config: str,
    variant: str,
    backend: Backend,
    preprocessor: Preprocessor | None = None,
    assessment: str | None = None,
    save_text: bool = True,
) -> int:
    """Embed works by partition: the leaf has the folders of the works' ``by`` column. Returns how many were embedded.

    The leaf's manifest keeps rows and content of each partition. A partition that does not hold what it says is emptied and
    embedded again as a whole; in all others only new and edited texts are embedded. Rows written are observed during the
    write and must be as many as were pending; every current text must then have a vector in its partition. The manifest
    is written last, so a run that fails leaves its partitions to be found damaged.
    """
    spark = works.sparkSession
    path = leaf_path(root, config, source, variant, assessment)
    prepare = preprocessor or variant_preprocessor(variant)
    # an id in two partitions is embedded in both
    parts = works.select(F.concat_ws("\u0000", F.coalesce(F.col(by).cast("string"), F.lit(NO_VALUE)), "id").alias("id"), "title", "abstract")
    texts = prepare(parts).withColumn("partition", F.substring_index("id", "\u0000", 1))
    # stored as they come: which of them are repeats, new or lost is told by their keys, so texts are not shuffled for that
    texts = cut_lineage(texts.withColumns({"id": F.expr("substring(id, length(partition) + 2)"), "row": F.monotonically_increasing_id()}))
    key = ["partition", "id", "text_hash"]
    keys = cut_lineage(texts.groupBy(*key).agg(F.min("row").alias("row")))

    broken = cut_lineage(damaged_partitions(spark, path, by))
    stored = _stored_by(spark, path, by)
    if stored is not None and not broken.isEmpty():
        drop_partitions(broken.select(F.col("partition").alias(by)), path, [by])
        stored = _stored_by(spark, path, by)
    todo = keys
    if stored is not None:
        held = _made_by(stored, backend).withColumn("partition", F.coalesce(F.col(by), F.lit(NO_VALUE)))
        todo = cut_lineage(keys.join(held.select(*key), key, "left_anti"))
    n = todo.count()
    if n:
        where = F.when(F.col("partition") != NO_VALUE, F.col("partition"))
        waiting = _rows_of(texts, todo) if n < texts.count() else texts
        keyed = waiting.select(F.concat_ws("\u0000", "partition", "id").alias("id"), "text_hash", "text", "title_clean", "abstract_clean")
        seen = Observation("written")
        vectors = embed_texts(keyed, backend, save_text).withColumn("partition", F.substring_index("id", "\u0000", 1))
        vectors = vectors.withColumns({"id": F.expr("substring(id, length(partition) + 2)"), by: where}).drop("partition")
        vectors.observe(seen, F.count("*").alias("n")).write.mode("append").partitionBy(by).parquet(path)
        if seen.get["n"] != n:
            raise ValueError(f"{path}: {seen.get['n']} rows written, {n} pending")
    stored = _stored_by(spark, path, by)
    if stored is None:
        return n
    held = _made_by(stored, backend).withColumn("partition", F.coalesce(F.col(by), F.lit(NO_VALUE))).select(*key)
    lost = keys.join(held, key, "left_anti").count()
    if lost:
        raise ValueError(f"{path}: {lost} current texts without a vector")
    if n or not broken.isEmpty():
        _contents(stored, by).coalesce(1).write.mode("overwrite").json(f"{path}/{MANIFEST}")
    return n
