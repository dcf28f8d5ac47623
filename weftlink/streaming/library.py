"""A reference library kept up to date: each sync reads what changed and replaces the chapters it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.text import extract_doi
from weftlink.operators.library import LIBRARY_COLUMNS, item_rows, one_per_chapter
from weftlink.session import cut_lineage
from weftlink.sources import paged
from weftlink.sources.parquet import drop_partitions, read_tree, replace_partitions

CHAPTERS = ["chapter"]


def stored_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_tree(spark, path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def assessment_path(root: str, label: str) -> str:
    return f"{root}/assessment={label}"


def merge_items(changes: DataFrame, path: str, group: str) -> None:
    """Put changed items (``page, position, item, key, version``) into the library under ``path``, by chapter.

    An item's rows are replaced wherever they were: in the chapters it had and in those it has now. Items that are
    gone leave; a chapter that loses its last row loses its folder. Applying the same changes twice changes nothing.
    """
    spark = changes.sparkSession
    changes = cut_lineage(changes)
    # an item may change twice in one batch: the later version counts
    latest = changes.groupBy("key").agg(F.max(F.struct("version", -F.col("page"), -F.col("position"), "item")).alias("c"))
    latest = latest.select("key", "c.item", "c.version").withColumnRenamed("key", "item_key")
    rows = item_rows(latest.filter("item is not null"), group)
    new = one_per_chapter(rows, ["version", "item_key"]).select(*LIBRARY_COLUMNS)
    stored = stored_or_none(spark, path)
    if stored is None:
        replace_partitions(new, path, CHAPTERS)
        return
    stored = stored.select(*LIBRARY_COLUMNS)
    touched = latest.select(F.col("item_key").alias("key"))
    new = cut_lineage(new)
    before = cut_lineage(stored.join(touched, "key", "left_semi").select(*CHAPTERS).distinct())
    chapters = before.union(new.select(*CHAPTERS)).distinct()
    kept = stored.join(F.broadcast(chapters), CHAPTERS, "left_semi").join(touched, "key", "left_anti")  # chapters: a handful of names
    whole = cut_lineage(kept.select(*LIBRARY_COLUMNS).unionByName(new))
    replace_partitions(whole, path, CHAPTERS)
    drop_partitions(before.join(whole, CHAPTERS, "left_anti"), path, CHAPTERS)


def sync_library(spark: SparkSession, root: str, label: str, checkpoint: str, group: str, **options: str) -> str:
    """Bring ``assessment=<label>`` up to the library's version of now and stop; returns its path.

    The stream's offsets are library versions, kept in the checkpoint: the first sync reads everything, a later one
    only items that changed. A sync that fails is done again from the same version.
    """
    paged.register(spark)
    path = assessment_path(root, label)
    stream = spark.readStream.format("library").options(group=group, **options).load()
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: merge_items(batch, path, group))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def sync_ids(library: DataFrame, path: str, fetch: Callable[[list[str]], list[dict]] = paged.fetch_ids, workers: int = 8) -> int:
    """Look up the ids of DOIs not asked for before and keep them under ``path``; returns how many were asked for.

    ``id, doi, asked``: a DOI without a work is kept with a null id, so it is asked for once too. The chapters of an
    id follow from the library by ``ids_by_chapter``, so a work in several chapters is looked up once.
    """
    spark = library.sparkSession
    wanted = library.select(extract_doi(F.col("doi")).alias("doi")).filter("doi != ''").distinct()
    known = stored_or_none(spark, path)
    if known is not None:
        wanted = wanted.join(known.select("doi"), "doi", "left_anti")
    wanted = cut_lineage(wanted)
    found = cut_lineage(paged.lookup_ids(wanted, fetch, workers)).select("id", extract_doi(F.col("doi")).alias("doi"))
    answered = wanted.join(found, "doi", "left").select("id", "doi")
    n = wanted.count()
    if n or known is None:
        answered.write.mode("append").parquet(path)
    return n


def known_ids(spark: SparkSession, path: str) -> DataFrame:
    """``id, doi`` of the DOIs that have a work."""
    return spark.read.parquet(path).filter("id is not null").select("id", "doi")
