"""From worksheets and libraries to link tables, each step a stored table.

Every function reads tables and writes one; a step is skipped when its table exists and was made from
the same settings and inputs, as recorded beside it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.config import Settings
from weftlink.operators.checks import require_complete, stale_rows_dropped
from weftlink.operators.definitions import prepare_definitions
from weftlink.operators.embedding import Backend, current_vectors, embed_works, leaf_path, title_abstract_text
from weftlink.operators.links import linked_pairs
from weftlink.operators.resolve import assessment_of, extract_citations, reference_index, resolve_citations
from weftlink.sources.paged import fetch_ids
from weftlink.sources.parquet import read_tree, rebuild
from weftlink.streaming.library import known_ids, sync_ids, sync_library


def input_mark(df: DataFrame) -> str:
    """Rows and an order-free hash of a table's content: the same table gives the same mark."""
    # null flags tell a missing value from another column's; a sum, unlike xor, keeps repeated rows apart
    nulls = [F.col(f"`{c}`").isNull() for c in df.columns]
    values = [F.col(f"`{c}`") for c in df.columns]
    hashed = [F.xxhash64(F.lit(seed), *values, *nulls).cast("decimal(38,0)") for seed in (1, 2)]
    row = df.agg(F.count("*"), *map(F.sum, hashed)).first()
    return ":".join(map(str, row))


def settings_mark(*parts) -> str:
    return json.dumps(parts, sort_keys=True, default=vars)


@dataclass
class Store:
    """Tables under one root; ``made_from`` of each is kept in ``<root>/_made_from/<table>``."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _mark_path(self, name: str) -> str:
        return f"{self.root}/_made_from/{name}"

    def made_from(self, name: str) -> str | None:
        try:
            row = self.spark.read.text(self._mark_path(name)).first()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return row[0] if row else None

    def make(
        self, name: str, inputs: list[str], build: Callable[[], DataFrame], partition_by: list[str] | None = None
    ) -> DataFrame:
        """Build and store a table unless it was made from these inputs before."""
        mark = hashlib.sha256("|".join(inputs).encode()).hexdigest()
        if self.made_from(name) != mark:
            rebuild(build(), self.path(name), partition_by)
            # written last: a table without its mark is made again
            self.spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(
                self._mark_path(name)
            )
        return self.read(name)

    def forget(self, name: str) -> None:
        """Have the table made again on the next run."""
        self.spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(self._mark_path(name))


def sync_libraries(spark: SparkSession, root: str, settings: Settings, fetch=fetch_ids, **options: str) -> tuple[DataFrame, DataFrame]:
    """The libraries of all assessments brought up to date, and the ids of their DOIs: ``library`` and ``ids``.

    ``settings.assessments`` has ``group`` (and ``key``, ``path``) of each label. What did not change is not read
    again, and a DOI is asked for once. ``library`` has ``assessment`` and ``chapter`` from its folders.
    """
    store = Store(spark, root)
    for label, spec in sorted(settings.assessments.items()):
        known = {k: str(v) for k, v in spec.items() if k in ("key", "path") and v}
        sync_library(spark, store.path("library"), label, store.path(f"_checkpoints/{label}"), str(spec["group"]), **known, **options)
    library = read_tree(spark, store.path("library"))
    sync_ids(library, store.path("ids"), fetch, settings.workers)
    return library, known_ids(spark, store.path("ids"))


def link_definitions(
    spark: SparkSession,
    root: str,
    settings: Settings,
    sheets: dict[str, DataFrame],
    library: DataFrame,
    ids: DataFrame,
    corpus: DataFrame,
    backend: Backend,
    library_order: list[str],
    top_n: int = 5,
) -> DataFrame:
    """Definitions, citations, resolved works, vectors and linked pairs, in that order."""
    store = Store(spark, root)
    sheet_marks = [f"{k}:{input_mark(v)}:{settings_mark(settings.sheets[k])}" for k, v in sorted(sheets.items())]
    definitions = store.make(
        "keypaper", sheet_marks,
        lambda: prepare_definitions({k: (v, settings.sheets[k]) for k, v in sheets.items()}), ["keyset"],
    )
    extracted = store.make("citations_extracted", sheet_marks, lambda: extract_citations(definitions), ["keyset"])
    index_marks = [input_mark(library), input_mark(ids), input_mark(corpus), settings_mark(library_order)]
    library_marks = [*sheet_marks, *index_marks, settings_mark(settings.citing, settings.default_assessment)]

    def resolve() -> DataFrame:
        index = store.make(
            "reference_index", index_marks,
            lambda: reference_index(library, ids, corpus, library_order, ["id"]),
        )
        cites = extracted.withColumn(
            "assessment", assessment_of(F.col("keyset"), settings.citing, settings.default_assessment)
        )
        return resolve_citations(cites, index)

    resolved = store.make("citations_resolved", library_marks, resolve, ["keyset"])
    model = settings.model
    prepare = lambda df: title_abstract_text(df, model.get("sep_token"), model.get("title_cap_combined"))
    vectors_root = store.path("embeddings")
    embed_works(definitions, vectors_root, "keypaper", settings.active, "title_abstract", backend, prepare)
    stored = spark.read.parquet(leaf_path(vectors_root, settings.active, "keypaper", "title_abstract"))
    vectors = stale_rows_dropped(current_vectors(stored, prepare(definitions), backend), definitions)
    require_complete(definitions, vectors)
    # one vector per text, however often it was stored
    vectors = vectors.dropDuplicates(["id"]).join(definitions.select("id", "keyset"), "id")

    def pairs() -> DataFrame:
        cites = resolved.select(F.col("keypaper_id").alias("id"), "keyset", F.col("matched_id").alias("work"))
        return linked_pairs(vectors.select("id", "keyset", "embedding"), cites, top_n, decimals=12)

    return store.make("linked_pairs", library_marks + [settings.fingerprint(), backend.provider, backend.model, str(top_n)], pairs)
