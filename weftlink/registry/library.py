"""Library items, DOIs and first-row rules."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from weftlink.functions.text import extract_doi, norm_doi
from weftlink.operators.library import ids_by_chapter, item_rows, one_per_chapter
from weftlink.operators.resolve import corpus_ids_of
from weftlink.plans.ordering import first_rows
from weftlink.registry.base import query, table
from weftlink.registry.citing import DOCS, corpus, known_ids, library_items
from weftlink.session import cut_lineage
from weftlink.sources.parquet import partition_values
from weftlink.sources.xlsx import sheet_rows


@query(
    "doi_normalise",
    r"""SELECT page_id, regexp_replace(regexp_replace(lower(trim(raw)), '^https?://(dx\.)?doi\.org/', ''), '^doi:', '') AS ndoi,
      lower(regexp_replace(regexp_extract(raw, '10\.\d{4,9}/\S+'), '[.,;)\]]+$', '')) AS doi
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' HTTPS://DOI.ORG/' WHEN 1 THEN 'http://dx.doi.org/' WHEN 2 THEN 'doi:' ELSE '' END
            || '10.1234/' || url || ').' AS raw FROM pages)""",
)
def doi_normalise(spark, sf_dir):
    form = F.col("page_id") % 4
    lead = (
        F.when(form == 0, F.lit(" HTTPS://DOI.ORG/"))
        .when(form == 1, F.lit("http://dx.doi.org/"))
        .when(form == 2, F.lit("doi:"))
        .otherwise("")
    )
    raw = F.concat(lead, F.lit("10.1234/"), F.col("url"), F.lit(")."))
    return table(spark, sf_dir, "pages").select("page_id", norm_doi(raw).alias("ndoi"), extract_doi(raw).alias("doi"))


@query(
    "id_coalesce_lookup",
    f"""WITH {DOCS},
      corpus AS (SELECT DISTINCT CASE WHEN quality = 1 THEN 'W' ELSE 'zotero:' END || doc_id AS id FROM labels)
    SELECT CAST(n.doc_id AS VARCHAR) AS key, coalesce(w.id, z.id) AS corpus_id
    FROM named n LEFT JOIN corpus w ON n.lang <> 'de' AND n.doc_id % 7 <> 0 AND w.id = 'W' || n.doc_id
    LEFT JOIN corpus z ON z.id = 'zotero:' || n.doc_id WHERE coalesce(w.id, z.id) IS NOT NULL""",
)
def id_coalesce_lookup(spark, sf_dir):
    items = library_items(spark, sf_dir)
    return corpus_ids_of(items, known_ids(spark, sf_dir), corpus(spark, sf_dir), ["id"]).select("key", "corpus_id")


# ---- nested items -------------------------------------------------------------------------
def json_items(spark, sf_dir):
    """Conversation turns as library items with creators and tags; one in three has no chapter tag."""
    turns = table(spark, sf_dir, "conversations")
    some = F.col("role") == "user"
    data = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("key"),
        F.col("role").alias("itemType"),
        F.col("text").alias("title"),
        F.array(
            F.struct(F.lit("").alias("lastName"), F.concat(F.lit("Group "), "conv_id").alias("name")),
            F.struct(F.col("role").alias("lastName"), F.lit(None).cast("string").alias("name")),
        ).alias("creators"),
        F.concat(F.lit("Spring "), (1990 + F.col("turn")).cast("int")).alias("date"),
        F.lit(None).cast("string").alias("DOI"),
        F.col("text").alias("abstractNote"),
        F.when(
            some,
            F.array(
                F.struct(F.concat(F.lit("chapter "), (F.col("turn") + 1)).alias("tag")),
                F.struct(F.lit("Chapter 9").alias("tag")),
                F.struct(F.lit("method").alias("tag")),
            ),
        ).alias("tags"),
    )
    return turns.select(F.to_json(F.struct(data.alias("data"))).alias("item"), "conv_id", "turn")


ITEMS = """
  items AS (
    SELECT conv_id || '-' || turn AS key, role AS item_type, text AS title,
           'Group ' || conv_id || '; ' || role AS authors, 'Group ' || conv_id AS first_author,
           CAST(1990 + turn AS VARCHAR) AS year, CAST(NULL AS VARCHAR) AS doi, text AS abstract,
           CASE WHEN role = 'user' THEN 'chapter ' || (turn + 1) || '; Chapter 9; method' END AS tags,
           'https://www.zotero.org/groups/77/items/' || conv_id || '-' || turn AS zotero_url,
           unnest(CASE WHEN role = 'user' THEN ['chapter ' || (turn + 1), 'Chapter 9'] ELSE ['No Chapter'] END) AS chapter
    FROM conversations)"""


@query("library_item_rows", f"WITH {ITEMS} SELECT * FROM items")
def library_item_rows(spark, sf_dir):
    return item_rows(json_items(spark, sf_dir), "77").drop("conv_id", "turn")


@query(
    "one_item_per_chapter",
    f"WITH {ITEMS}, twice AS (SELECT * FROM items UNION ALL SELECT * FROM items) SELECT DISTINCT key, chapter FROM twice",
)
def one_item_per_chapter(spark, sf_dir):
    items = json_items(spark, sf_dir)
    rows = item_rows(items.unionByName(items), "77")
    return one_per_chapter(rows, ["conv_id", "turn"]).select("key", "chapter")


@query(
    "json_props_flatten",
    """SELECT event_id, CAST(json_extract(p, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(p, '$.missing'), 'none') AS missing
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN replace(props, '}', ', "missing": "of ' || event_id || '"}') ELSE props END AS p FROM events)""",
)
def json_props_flatten(spark, sf_dir):
    """A field that a third of the rows have, with a default for the others."""
    more = F.concat(F.lit(', "missing": "of '), "event_id", F.lit('"}'))
    props = F.when(F.col("event_id") % 3 == 0, F.replace(F.col("props"), F.lit("}"), more)).otherwise(F.col("props"))
    parsed = F.from_json(props, "k bigint, missing string")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", parsed.alias("p"))
        .select("event_id", F.col("p.k").alias("k"), F.coalesce("p.missing", F.lit("none")).alias("missing"))
    )


@query(
    "ids_by_chapter",
    """SELECT DISTINCT lang AS chapter, unnest(list_filter(['W' || doc_id, CASE WHEN doc_id % 5 = 0 THEN 'X' || doc_id END,
        CASE WHEN doc_id % 7 = 0 THEN 'V' || doc_id END], lambda i: i IS NOT NULL)) AS id, '10.1234/abc' || doc_id AS doi
    FROM documents WHERE lang <> 'de'""",
)
def ids_per_chapter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("chapter"), F.col("doc_id").cast("string").alias("key"))
    items = docs.join(library_items(spark, sf_dir).select("key", "doi"), "key")
    return ids_by_chapter(items, known_ids(spark, sf_dir))


@query(
    "distinct_on_first",
    "SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1",
)
def distinct_on_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return first_rows(docs, ["source", "lang"], ["doc_id"])


@query("partition_values", "SELECT DISTINCT source, lang FROM documents")
def distinct_partitions(spark, sf_dir):
    return partition_values(table(spark, sf_dir, "documents"), ["source", "lang"])


# ---- worksheets ---------------------------------------------------------------------------
def workbook(columns: list[str], rows: list[list[str | None]]) -> bytes:
    """A workbook with the sheet ``Parts``, cells as inline text."""
    name = lambda i: chr(65 + i)
    cell = lambda i, j, v: f'<c r="{name(i)}{j}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    line = lambda j, row: f'<row r="{j}">' + "".join(cell(i, j, v) for i, v in enumerate(row) if v is not None) + "</row>"
    body = "".join(line(j, row) for j, row in enumerate([columns, *rows], 1))
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Parts" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def part_books(spark, sf_dir):
    """A workbook for each brand; every other brand's has no size column, and columns stand in another order."""

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        brand = rows["p_brand"].iloc[0]
        columns = ["Key", "Name", "Size"] if int(brand[-1]) % 2 else ["Name", "Key"]
        source = {"Key": "p_partkey", "Name": "p_name", "Size": "p_size"}
        cells = rows.sort_values("p_partkey")[[source[c] for c in columns]].astype(str).values.tolist()
        return pd.DataFrame({"path": [brand], "content": [workbook(columns, cells)]})

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    return parts.groupBy("p_brand").applyInPandas(make, "path string, content binary")


@query(
    "sheet_rows",
    """SELECT CAST(p_partkey AS VARCHAR) AS "Key", p_name AS "Name",
      CASE WHEN CAST(right(p_brand, 1) AS INT) % 2 = 1 THEN CAST(p_size AS VARCHAR) END AS "Size" FROM part""",
)
def parts_from_sheets(spark, sf_dir):
    """Parts written into workbooks and read back, with the columns of all of them."""
    return sheet_rows(cut_lineage(part_books(spark, sf_dir)), "Parts").select("Key", "Name", "Size")
