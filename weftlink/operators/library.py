"""Reference-library items and their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions.text import blank_to_null, extract_doi, year_from_date
from weftlink.plans.ordering import first_rows

# ---- fixed values -------------------------------------------------------------------------
ITEM_SCHEMA = (
    "struct<data: struct<key: string, itemType: string, title: string,"
    " creators: array<struct<lastName: string, name: string>>,"
    " date: string, DOI: string, abstractNote: string, tags: array<struct<tag: string>>>>"
)
CHAPTER_PATTERN = "^Chapter"
NO_CHAPTER = "No Chapter"
ITEM_URL = "https://www.zotero.org/groups/"
# -------------------------------------------------------------------------------------------

LIBRARY_COLUMNS = [
    "key", "item_type", "title", "authors", "first_author", "year", "doi", "abstract", "tags", "zotero_url", "chapter",
]


def _creator_name(c: Column) -> Column:
    return F.coalesce(blank_to_null(c["lastName"]), blank_to_null(c["name"]))


def item_rows(items: DataFrame, group_id: str, json: str = "item", pattern: str = CHAPTER_PATTERN) -> DataFrame:
    """Library items (JSON text) as rows, one per chapter tag, keeping the other input columns that no field replaces."""
    kept = [c for c in items.columns if c != json and c not in LIBRARY_COLUMNS]
    data = items.select(*kept, F.from_json(json, ITEM_SCHEMA)["data"].alias("d"))
    names = F.transform("d.creators", _creator_name)
    tags = F.filter(F.transform("d.tags", lambda t: t["tag"]), lambda t: t.isNotNull() & (t != ""))
    shaped = data.select(*kept, "d", names.alias("names"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))
    chapters = F.filter("tags", lambda t: t.rlike(f"(?i){pattern}"))
    named = F.filter("names", lambda n: n.isNotNull())
    return shaped.select(
        *kept,
        F.col("d.key").alias("key"),
        F.col("d.itemType").alias("item_type"),
        F.col("d.title").alias("title"),
        blank_to_null(F.array_join(named, "; ")).alias("authors"),
        F.get("names", 0).alias("first_author"),
        year_from_date(F.col("d.date")).alias("year"),
        F.col("d.DOI").alias("doi"),
        F.col("d.abstractNote").alias("abstract"),
        blank_to_null(F.array_join("tags", "; ")).alias("tags"),
        F.concat(F.lit(f"{ITEM_URL}{group_id}/items/"), F.col("d.key")).alias("zotero_url"),
        F.explode(F.when(F.size(chapters) > 0, chapters).otherwise(F.array(F.lit(NO_CHAPTER)))).alias("chapter"),
    )


def one_per_chapter(rows: DataFrame, order: list[str]) -> DataFrame:
    """Repeats of an item inside a chapter collapse to the first."""
    return first_rows(rows, ["chapter", "key"], order)


def ids_by_chapter(library: DataFrame, known: DataFrame) -> DataFrame:
    """``chapter, id, doi`` for every resolvable DOI; each DOI is looked up once, not per chapter."""
    wanted = library.select("chapter", extract_doi(F.col("doi")).alias("doi")).filter("doi != ''").distinct()
    return wanted.join(known.select("id", extract_doi(F.col("doi")).alias("doi")), "doi").select("chapter", "id", "doi")
