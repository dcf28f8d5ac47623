"""Text, token and label expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
CHARS_PER_TOKEN = 4
TOKEN_LIMIT = 512
ESTIMATE_TITLE_CAP = 200
ESTIMATE_SEPARATOR = "[SEP]"
WHITESPACE = " \t\r\n"
TYPOGRAPHIC = "‘’“”–—"
TYPOGRAPHIC_ASCII = "''\"\"--"
YEAR_IN_DATE = "[12][0-9]{3}"
DOI_PATTERN = r"10\.\d{4,9}/\S+"
AXIS_SUFFIX = r"(?i)\s+approaches$"
# -------------------------------------------------------------------------------------------


def trim_ws(c: Column) -> Column:
    """Trim blanks, tabs and line ends (plain ``trim`` only takes blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def squish(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def column_or_null(columns: list[str], name: str) -> Column:
    """The trimmed source column, or NULL when the sheet lacks it."""
    return trim_ws(F.col(f"`{name}`")) if name in columns else F.lit(None).cast("string")


def estimate_tokens(c: Column) -> Column:
    return F.coalesce(F.ceil(F.length(c) / CHARS_PER_TOKEN), F.lit(0)).cast("int")


def count_words(c: Column) -> Column:
    parts = F.split(trim_ws(F.coalesce(c, F.lit(""))), r"\s+")
    return F.size(F.filter(parts, lambda w: w != ""))


def estimate_text(title: Column, abstract: Column) -> Column:
    """The text whose size is estimated, always with the separator token and the capped title."""
    return F.concat(
        F.substring(F.coalesce(title, F.lit("")), 1, ESTIMATE_TITLE_CAP),
        F.lit(f" {ESTIMATE_SEPARATOR} "),
        F.coalesce(abstract, F.lit("")),
    )


def shorten_by_words(words: Column, tokens: Column, limit: int = TOKEN_LIMIT) -> Column:
    """How many words must go for the text to fit the model's token limit."""
    share = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(tokens, F.lit(1)))
    return F.greatest(F.lit(0), words - F.floor(words * share)).cast("int")


def ascii_punctuation(c: Column) -> Column:
    return F.translate(c, TYPOGRAPHIC, TYPOGRAPHIC_ASCII)


def display_label(id_: Column, title: Column, code: Column, short_name: Column, cap: int = 60) -> Column:
    """Short name, else ``code title``, else title, else the id."""
    base = F.coalesce(F.substring(blank_to_null(title), 1, cap), id_)
    coded = F.when(blank_to_null(code).isNotNull(), F.concat_ws(" ", code, base)).otherwise(base)
    return F.coalesce(blank_to_null(short_name), coded)


def axis_label(c: Column) -> Column:
    return F.regexp_replace(c, AXIS_SUFFIX, "")


def year_from_date(c: Column) -> Column:
    """First four-digit year in a free-form date, as text."""
    return blank_to_null(F.regexp_extract(c, YEAR_IN_DATE, 0))


def year_int(c: Column) -> Column:
    """Leading digits as an integer, NULL when there are none."""
    return F.regexp_replace(c, r"(?s)[^0-9].*$", "").try_cast("int")


def norm_doi(c: Column) -> Column:
    """Bare lower-case DOI; NULL becomes the empty string."""
    bare = F.lower(trim_ws(F.coalesce(c, F.lit(""))))
    bare = F.regexp_replace(bare, r"^https?://(dx\.)?doi\.org/", "")
    return trim_ws(F.regexp_replace(bare, r"^doi:", ""))


def extract_doi(c: Column) -> Column:
    """The DOI inside any text, normalised; empty when there is none."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), DOI_PATTERN, 0)
    return F.lower(F.regexp_replace(found, r"[.,;)\]]+$", ""))


def html_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def strip_latex(c: Column) -> Column:
    """``$x$`` to x, ``\\cmd{x}`` to x, a bare ``\\cmd`` to a blank."""
    out = F.regexp_replace(c, r"\$([^$]+)\$", "$1")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+\{([^}]*)\}", "$1")
    return F.regexp_replace(out, r"\\[a-zA-Z]+", " ")


def strip_abstract_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^\s*(abstract|summary)\s*[:—\-.]?\s+", "")


def text_hash(c: Column) -> Column:
    """Change marker for a text; only equality has meaning."""
    return F.lower(F.hex(F.xxhash64(c)))
