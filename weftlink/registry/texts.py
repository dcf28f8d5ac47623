"""Cleaning, token estimates, labels and embedding texts over whole documents and pages."""

from pyspark.sql import functions as F

from weftlink.functions import text as T
from weftlink.functions.html import clean_abstract, clean_title, finish_clean, html_to_text
from weftlink.operators.definitions import SheetMap, definition_meta, definition_summary, prepare_definitions
from weftlink.operators.embedding import HashBackend, abstract_text, embed_texts, title_abstract_text, title_text
from weftlink.registry.base import query, table, texts

SPACES = r"[\s\p{Z}]+"
TRIM = "E' \\t\\r\\n'"


def latex_sql(c: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace({c}, '\$([^$]+)\$', '\1', 'g'), "
        r"'\\[a-zA-Z]+\{([^}]*)\}', '\1', 'g'), '\\[a-zA-Z]+', ' ', 'g')"
    )


def squish_sql(c: str) -> str:
    return f"nullif(trim(regexp_replace({c}, '{SPACES}', ' ', 'g')), '')"


def prefix_sql(c: str) -> str:
    return rf"regexp_replace({c}, '(?i)^\s*(abstract|summary)\s*[:—\-.]?\s+', '')"


# SQL has no HTML parser. These pages hide one tag look-alike in their script, which is kept apart while
# tags go, and use four entities.
PAGE_TEXT = r"""
  shielded AS (SELECT page_id, replace(html, 'var t="</p>"', 'var t="' || chr(1) || '"') AS h FROM pages),
  bare AS (
    SELECT page_id, regexp_replace(regexp_replace(h, '<!--.*?-->', '', 'gs'), '</?[A-Za-z!][^>]*>', '', 'g') AS h
    FROM shielded),
  page_text AS (
    SELECT page_id,
           replace(replace(replace(replace(replace(h, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'),
                   chr(1), '</p>') AS plain
    FROM bare)"""


@query("html_text", f"WITH {PAGE_TEXT} SELECT page_id, plain FROM page_text")
def html_text(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", html_to_text("html").alias("plain"))


@query("clean_html_text", f"WITH {PAGE_TEXT} SELECT page_id, {squish_sql(latex_sql('plain'))} AS title_clean FROM page_text")
def clean_html_text(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", clean_title(F.col("html")).alias("title_clean"))


LATEX_TEXT = (
    "CASE lang WHEN 'en' THEN 'Abstract: ' WHEN 'fr' THEN 'SUMMARY — ' ELSE '' END "
    r"|| '\emph{' || source || '} $x_1$ \alpha ' || text"
)


@query(
    "latex_and_prefix_clean",
    f"SELECT doc_id, {squish_sql(latex_sql(prefix_sql(LATEX_TEXT)))} AS abstract_clean FROM documents",
)
def latex_and_prefix_clean(spark, sf_dir):
    lead = F.when(F.col("lang") == "en", F.lit("Abstract: ")).when(F.col("lang") == "fr", F.lit("SUMMARY — ")).otherwise("")
    raw = F.concat(lead, F.lit("\\emph{"), F.col("source"), F.lit("} $x_1$ \\alpha "), F.col("text"))
    return texts(spark, sf_dir, "documents").select("doc_id", finish_clean(raw, drop_prefix=True).alias("abstract_clean"))


# ---- definitions from two sheets ----------------------------------------------------------
def sheets(spark, sf_dir):
    """Documents and benchmark items as two worksheets with different columns."""
    docs = texts(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("ID"),
        F.regexp_extract("text", r"^[^\n]*", 0).alias("Heading"),
        F.col("text").alias("Wording"),
        F.col("lang").alias("Group"),
        F.when(F.col("lang") == "en", F.col("source")).alias("Short Name"),
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("ID"),
        F.lit(None).cast("string").alias("Heading"),
        F.col("text").alias("Wording"),
    )
    return {
        "documents": (
            docs,
            SheetMap(id="ID", title="Heading", abstract_raw="Wording", category="Group", short_name="Short Name"),
        ),
        "benchmark": (items, SheetMap(id="ID", title="Heading", abstract_raw="Wording", id_prefix="ITEM:")),
    }


def _strip_sql(c: str) -> str:
    from weftlink.functions.citations import YEAR_PARENTHESIS

    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '{YEAR_PARENTHESIS}', '', 'g'), "
        r"'\s+([,.;:])', '\1', 'g'), '\(\s*[;,]?\s*\)', '', 'g'), '[ \t]{2,}', ' ', 'g'), " + TRIM + ")"
    )


PREPARED = f"""
  sheets AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS source_id, 'documents' AS keyset,
           trim(regexp_extract(text, '^[^\\n]*'), {TRIM}) AS title, trim(text, {TRIM}) AS abstract_raw, lang AS category,
           CASE WHEN lang = 'en' THEN source END AS short_name
    FROM documents
    UNION ALL
    SELECT 'ITEM:' || item_id, CAST(item_id AS VARCHAR), 'benchmark', NULL, trim(text, {TRIM}), NULL, NULL FROM benchmark),
  stripped AS (SELECT *, {_strip_sql("abstract_raw")} AS abstract FROM sheets WHERE abstract_raw <> ''),
  joined AS (
    SELECT *, substr(coalesce(title, ''), 1, 200) || ' [SEP] ' || coalesce(abstract, '') AS ta FROM stripped),
  counted AS (
    SELECT *, CAST(coalesce(ceil(length(title) / 4.0), 0) AS INT) AS title_tokens_est,
           CAST(coalesce(ceil(length(abstract) / 4.0), 0) AS INT) AS abstract_tokens_est,
           CAST(ceil(length(ta) / 4.0) AS INT) AS title_abstract_tokens_est,
           len(list_filter(string_split_regex(trim(ta, {TRIM}), '\\s+'), lambda w: w <> '')) AS words
    FROM joined),
  prepared AS (
    SELECT id, source_id, keyset, title, abstract, abstract_raw, category, CAST(NULL AS VARCHAR) AS code, short_name,
           CAST(NULL AS VARCHAR) AS primary_approach, CAST(NULL AS VARCHAR) AS secondary_approach,
           title_tokens_est, abstract_tokens_est, title_abstract_tokens_est,
           CAST(greatest(0, words - floor(words * least(1.0, CAST(512 AS DOUBLE) / greatest(title_abstract_tokens_est, 1)))) AS INT)
             AS shorten_title_abstract_by_words
    FROM counted)"""


@query("definitions_prepared", f"WITH {PREPARED} SELECT * FROM prepared")
def definitions_prepared(spark, sf_dir):
    return prepare_definitions(sheets(spark, sf_dir))


@query(
    "definition_summary",
    f"""WITH {PREPARED}
    SELECT count(*) AS n_definitions, count(DISTINCT keyset) AS n_keysets, median(title_abstract_tokens_est) AS median_tokens,
           max(title_abstract_tokens_est) AS max_tokens, count_if(title_abstract_tokens_est > 512) AS n_over_limit,
           max(shorten_title_abstract_by_words) AS max_words_over FROM prepared""",
)
def definition_summary_row(spark, sf_dir):
    return definition_summary(prepare_definitions(sheets(spark, sf_dir), check=False))


@query(
    "labels_with_fallback",
    f"""WITH {PREPARED},
      coded AS (
        SELECT *, CASE WHEN length(id) % 2 = 0 THEN upper(substr(id, 1, 4)) WHEN length(id) % 3 = 0 THEN '' END AS given,
               translate(title, '‘’“”–—', '''''""--') AS plain FROM prepared)
    SELECT id, coalesce(nullif(short_name, ''),
      CASE WHEN nullif(given, '') IS NOT NULL THEN given || ' ' ELSE '' END || coalesce(substr(nullif(plain, ''), 1, 60), id)) AS label
    FROM coded""",
)
def labels_with_fallback(spark, sf_dir):
    """Short name, code with title, title alone, id: codes are given to ids of even length, and are blank for some others."""
    meta = definition_meta(prepare_definitions(sheets(spark, sf_dir), check=False))
    size = F.length("id")
    code = F.when(size % 2 == 0, F.upper(F.substring("id", 1, 4))).when(size % 3 == 0, F.lit(""))
    return meta.select("id", T.display_label(F.col("id"), F.col("title"), code, F.col("short_name")).alias("label"))


@query(
    "token_estimates",
    r"""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INT) AS tokens,
      len(list_filter(string_split_regex(trim(text, E' \t\r\n'), '\s+'), lambda w: w <> '')) AS words FROM documents""",
)
def token_estimates(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select(
        "doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.count_words(F.col("text")).alias("words")
    )


@query(
    "translate_quotes",
    """SELECT doc_id, translate('“' || text || '” – ‘' || source || '’ — end', '‘’“”–—', '''''""--') AS plain FROM documents""",
)
def translate_quotes(spark, sf_dir):
    quoted = F.concat(F.lit("“"), "text", F.lit("” – ‘"), "source", F.lit("’ — end"))
    return texts(spark, sf_dir, "documents").select("doc_id", T.ascii_punctuation(quoted).alias("plain"))


@query(
    "axis_label_suffix",
    r"SELECT p_partkey, regexp_replace(p_name || '  Approaches', '(?i)\s+approaches$', '') AS label FROM part",
)
def axis_label_suffix(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.axis_label(F.concat("p_name", F.lit("  Approaches"))).alias("label")
    )


# ---- embedding texts ----------------------------------------------------------------------
def titled(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"),
        F.col("text").alias("abstract"),
    )


# the documents hold no markup, so cleaning is the part after it
TITLED = f"""
  cleaned AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, {squish_sql(latex_sql(r"regexp_extract(text, '^[^\n]*')"))} AS title_clean,
           {squish_sql(latex_sql(prefix_sql("text")))} AS abstract_clean
    FROM documents),
  texts AS (
    SELECT *, substr(title_clean, 1, 200) || '  ' || abstract_clean AS text FROM cleaned
    WHERE title_clean IS NOT NULL AND abstract_clean IS NOT NULL)"""


@query("title_abstract_text", f"WITH {TITLED} SELECT id, title_clean, abstract_clean, text FROM texts")
def title_abstract_texts(spark, sf_dir):
    return title_abstract_text(titled(spark, sf_dir), separator="", title_cap=200).drop("text_hash")


@query("title_text", f"WITH {TITLED} SELECT id, title_clean, abstract_clean, title_clean AS text FROM cleaned WHERE title_clean IS NOT NULL")
def title_texts(spark, sf_dir):
    return title_text(titled(spark, sf_dir)).drop("text_hash")


@query("abstract_text", f"WITH {TITLED} SELECT id, title_clean, abstract_clean, abstract_clean AS text FROM cleaned WHERE abstract_clean IS NOT NULL")
def abstract_texts(spark, sf_dir):
    return abstract_text(titled(spark, sf_dir)).drop("text_hash")


def _byte_sql(i: int) -> str:
    hexa = "'0123456789abcdef'"
    return (
        f"((instr({hexa}, substr(md5(text), {2 * i + 1}, 1)) - 1) * 16 + instr({hexa}, substr(md5(text), {2 * i + 2}, 1)) - 1)"
        " / CAST(255 AS DOUBLE)"
    )


@query(
    "embed_with_test_backend",
    f"WITH {TITLED} SELECT id, 'hash' AS provider, 'md5' AS model_id, "
    + ", ".join(f"{_byte_sql(i)} AS v{i + 1}" for i in range(4))
    + " FROM texts",
)
def embed_with_test_backend(spark, sf_dir):
    prepared = title_abstract_text(titled(spark, sf_dir), separator="", title_cap=200)
    vectors = embed_texts(prepared, HashBackend(width=4))
    return vectors.select("id", "provider", "model_id", *[F.get("embedding", i).alias(f"v{i + 1}") for i in range(4)])


@query(
    "html_escape",
    """SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe
    FROM documents""",
)
def html_escaped(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", T.html_escape(F.col("text")).alias("safe"))
