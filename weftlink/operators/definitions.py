"""Worksheets of concept definitions on one schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.citations import strip_citations
from weftlink.functions.text import (
    TOKEN_LIMIT,
    ascii_punctuation,
    column_or_null,
    count_words,
    estimate_text,
    estimate_tokens,
    shorten_by_words,
)
from weftlink.operators.checks import require_unique

MAPPED = ["title", "abstract_raw", "category", "code", "short_name", "primary_approach", "secondary_approach"]
COLUMNS = [
    "id", "source_id", "keyset", "title", "abstract", "abstract_raw", "category", "code", "short_name",
    "primary_approach", "secondary_approach", "title_tokens_est", "abstract_tokens_est",
    "title_abstract_tokens_est", "shorten_title_abstract_by_words",
]


@dataclass(frozen=True)
class SheetMap:
    """Which worksheet column feeds which field; fields without a column are NULL."""

    id: str
    title: str
    abstract_raw: str
    id_prefix: str = ""
    category: str | None = None
    code: str | None = None
    short_name: str | None = None
    primary_approach: str | None = None
    secondary_approach: str | None = None


def map_sheet(sheet: DataFrame, keyset: str, spec: SheetMap) -> DataFrame:
    """One worksheet on the shared fields, rows without id or definition dropped.

    A missing id stays missing: a prefix does not turn it into a key.
    """
    columns = sheet.columns
    source_id = column_or_null(columns, spec.id)
    fields = {name: getattr(spec, name) for name in MAPPED}
    mapped = sheet.select(
        F.concat(F.lit(spec.id_prefix), source_id).alias("id"),
        source_id.alias("source_id"),
        F.lit(keyset).alias("keyset"),
        *[
            (column_or_null(columns, source) if source else F.lit(None).cast("string")).alias(name)
            for name, source in fields.items()
        ],
    )
    return mapped.filter((F.col("source_id") != "") & (F.col("abstract_raw") != ""))


def with_estimates(rows: DataFrame) -> DataFrame:
    """Citation-free abstract, token estimates and the words over the limit."""
    text = estimate_text(F.col("title"), F.col("abstract"))
    return (
        rows.withColumn("abstract", strip_citations(F.col("abstract_raw")))
        .withColumns(
            {
                "title_tokens_est": estimate_tokens(F.col("title")),
                "abstract_tokens_est": estimate_tokens(F.col("abstract")),
                "title_abstract_tokens_est": estimate_tokens(text),
                "_words": count_words(text),
            }
        )
        .withColumn(
            "shorten_title_abstract_by_words",
            shorten_by_words(F.col("_words"), F.col("title_abstract_tokens_est")),
        )
        .select(*COLUMNS)
    )


def prepare_definitions(sheets: dict[str, tuple[DataFrame, SheetMap]], check: bool = True) -> DataFrame:
    """All worksheets (keyset -> sheet and mapping) as one table with unique ids."""
    parts = [map_sheet(sheet, keyset, spec) for keyset, (sheet, spec) in sheets.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if check:
        require_unique(rows, "id")
    return with_estimates(rows)


def definition_summary(definitions: DataFrame) -> DataFrame:
    tokens = F.col("title_abstract_tokens_est")
    return definitions.agg(
        F.count("*").alias("n_definitions"),
        F.countDistinct("keyset").alias("n_keysets"),
        F.median(tokens).alias("median_tokens"),
        F.max(tokens).alias("max_tokens"),
        F.count_if(tokens > TOKEN_LIMIT).alias("n_over_limit"),
        F.max("shorten_title_abstract_by_words").alias("max_words_over"),
    )


def definition_meta(definitions: DataFrame) -> DataFrame:
    """The columns figures need, with plain quotes and dashes in titles."""
    return definitions.select(
        "id", "keyset", ascii_punctuation(F.col("title")).alias("title"), "code", "short_name", "category"
    )
