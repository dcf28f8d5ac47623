"""Citation grammar and resolution over whole document texts.

The documents carry no dated citations of their own, so each text gets two sentences citing names made
of its own words; the whole text is then searched.
"""

from pyspark.sql import functions as F

from weftlink.functions.citations import (
    PARENTHESIS,
    YEAR,
    YEAR_PARENTHESIS,
    narrative_pattern,
    strip_citations,
)
from weftlink.functions.names import (
    ACCENTED,
    AFTER_FIRST_AUTHOR,
    INITIALS,
    LETTER_PAIRS,
    ONLY_PARTICLES,
    SURNAME_WITH_PARTICLES,
    UNACCENTED,
    leading_qualifiers,
    surname_key,
)
from weftlink.operators.resolve import (
    assessment_of,
    citation_rows,
    citing_places,
    extract_citations,
    loose_matches,
    match_summary,
    reference_index,
    resolution_totals,
    resolve_citations,
    resolve_places,
    strict_matches,
)
from weftlink.registry.base import literal, query, table, texts
from weftlink.session import cut_lineage

# a capitalised word; every one of a text is a name
NAME = "[A-ZÀ-Þ][A-Za-zÀ-ÿ]+"


def named_documents(spark, sf_dir):
    """Documents with ``names``, all different capitalised words of the whole text in order, and two years.

    ``n1`` to ``n4`` are taken from all over the list by the document's number.
    """
    docs = texts(spark, sf_dir, "documents")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))))
    some = docs.withColumn("names", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("Anon"))))
    picked = [
        F.element_at("names", (F.pmod(F.col("doc_id") * i, F.size("names")) + 1).cast("int")).alias(f"n{i}") for i in range(1, 5)
    ]
    return some.select(
        "doc_id", "text", "lang", "source", "names", *picked,
        (1990 + F.col("n_chars") % 30).cast("int").alias("y1"),
        (1990 + F.col("doc_id") % 30).cast("int").alias("y2"),
    )


def citing_documents(spark, sf_dir):
    """``keyset, id, source_id, abstract_raw``: each whole text with its citing sentences."""
    named = named_documents(spark, sf_dir)
    body = F.concat(
        F.col("text"), F.lit(" "), F.col("n1"), F.lit(" et al. ("), F.col("y1"), F.lit(") and (e.g. "), F.col("n2"),
        F.lit(" & "), F.col("n3"), F.lit(", "), F.col("y2"), F.lit("a; see also van "), F.col("n4"),
        F.lit(", 1999, 2001; "), F.array_join("names", ", 2004; "), F.lit(", 2004)."),
    )
    return named.select(
        F.col("lang").alias("keyset"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"),
        body.alias("abstract_raw"),
    )


DOCS = f"""
  worded AS (SELECT *, list_sort(list_distinct(regexp_extract_all(text, '{NAME}'))) AS found FROM documents),
  listed AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE ['Anon'] END AS names FROM worded),
  named AS (
    SELECT doc_id, text, lang, source, names, {", ".join(f"names[(doc_id * {i}) % len(names) + 1] AS n{i}" for i in range(1, 5))},
           1990 + n_chars % 30 AS y1, 1990 + doc_id % 30 AS y2 FROM listed),
  citing AS (
    SELECT lang AS keyset, CAST(doc_id AS VARCHAR) AS id, source AS source_id,
           text || ' ' || n1 || ' et al. (' || y1 || ') and (e.g. ' || n2 || ' & ' || n3 || ', ' || y2
             || 'a; see also van ' || n4 || ', 1999, 2001; ' || array_to_string(names, ', 2004; ') || ', 2004).' AS abstract_raw
    FROM named)"""

TRIM = "E' \\t\\r\\n'"


def author_key_sql(c: str) -> str:
    out = f"translate(coalesce({c}, ''), {literal(ACCENTED)}, {literal(UNACCENTED)})"
    for letter, pair in LETTER_PAIRS.items():
        out = f"replace({out}, '{letter}', '{pair}')"
    return f"regexp_replace(lower({out}), '[^a-z]', '', 'g')"


def surname_sql(source: str, phrase: str, out: str = "author_key") -> str:
    """A subquery adding the surname key of a phrase column."""
    first = f"regexp_replace(regexp_replace(trim({phrase}, {TRIM}), {literal(leading_qualifiers(chr(92) + "b"))}, ''), {literal(AFTER_FIRST_AUTHOR)}, '')"
    tokens = f"list_filter(string_split_regex(trim({first}, {TRIM}), '\\s+'), lambda t: t <> '')"
    kept = f"list_filter(_tokens, lambda t: NOT regexp_matches(t, {literal(INITIALS)}))"
    name = "array_to_string(CASE WHEN len(_kept) > 0 THEN _kept ELSE _tokens[-1:] END, ' ')"
    head = (
        f"CASE WHEN regexp_matches(_name, {literal(ONLY_PARTICLES)}) THEN _name || ' na' "
        f"ELSE regexp_extract(_name, {literal(SURNAME_WITH_PARTICLES)}) END"
    )
    return f"""(
      SELECT * EXCLUDE (_tokens, _kept, _name), CASE WHEN len(_tokens) > 0 THEN nullif({author_key_sql(head)}, '') END AS {out}
      FROM (SELECT *, {name} AS _name FROM (SELECT *, {kept} AS _kept FROM (SELECT *, {tokens} AS _tokens FROM {source}))))"""


EXTRACTED = f"""{DOCS},
  found_n AS (
    SELECT keyset, id, source_id, unnest(regexp_extract_all(abstract_raw, {literal(narrative_pattern())})) AS raw,
           unnest(regexp_extract_all(abstract_raw, {literal(narrative_pattern())}, 1)) AS phrase,
           unnest(regexp_extract_all(abstract_raw, {literal(narrative_pattern())}, 2)) AS year,
           generate_subscripts(regexp_extract_all(abstract_raw, {literal(narrative_pattern())}), 1) AS g, 0 AS c, 0 AS y
    FROM citing),
  groups AS (
    SELECT keyset, id, source_id, unnest(gs) AS raw, generate_subscripts(gs, 1) AS g
    FROM (SELECT keyset, id, source_id, regexp_extract_all(abstract_raw, {literal(PARENTHESIS)}) AS gs FROM citing)),
  chunks AS (
    SELECT * EXCLUDE (cs), trim(unnest(cs), {TRIM}) AS chunk, generate_subscripts(cs, 1) AS c
    FROM (SELECT *, string_split(substr(raw, 2, length(raw) - 2), ';') AS cs FROM groups
          WHERE regexp_matches(raw, {literal(YEAR)}))),
  dated AS (
    SELECT * EXCLUDE (ys), unnest(ys) AS year, generate_subscripts(ys, 1) AS y
    FROM (SELECT *, regexp_extract_all(chunk, {literal(YEAR)}, 1) AS ys,
                 trim(regexp_replace(trim(regexp_replace(chunk, {literal(YEAR + "[^" + chr(92) + "n]*$")}, ''), {TRIM}), '[,;]+$', ''), {TRIM}) AS phrase
          FROM chunks)),
  phrases AS (
    SELECT keyset, id, source_id, raw, phrase, year, g, c, y, 0 AS kind FROM found_n
    UNION ALL
    SELECT keyset, id, source_id, raw, phrase, year, g, c, y, 1 FROM dated WHERE phrase <> ''),
  keyed AS (SELECT * FROM {surname_sql("phrases", "phrase")}),
  firsts AS (
    SELECT keyset, id, source_id, raw, author_key, CAST(year AS INT) AS year, min(struct_pack(kind := kind, g := g, c := c, y := y)) AS place
    FROM keyed WHERE author_key IS NOT NULL GROUP BY ALL),
  extracted AS (
    SELECT keyset, id AS keypaper_id, source_id, raw AS raw_citation, author_key, year,
           row_number() OVER (PARTITION BY id ORDER BY place) AS cite_seq
    FROM firsts)"""


@query("citations_extracted", f"WITH {EXTRACTED} SELECT * FROM extracted")
def citations_extracted(spark, sf_dir):
    return extract_citations(citing_documents(spark, sf_dir))


@query(
    "citations_per_keyset",
    f"""WITH {EXTRACTED}
    SELECT keyset, count(*) AS n_citations, count(DISTINCT keypaper_id) AS n_definitions FROM extracted GROUP BY keyset""",
)
def citations_per_keyset(spark, sf_dir):
    places = citing_places(citing_documents(spark, sf_dir))
    cites = citation_rows(places, raw=False).select("keyset", "keypaper_id")
    return cites.groupBy("keyset").agg(F.count("*").alias("n_citations"), F.countDistinct("keypaper_id").alias("n_definitions"))


STRIPPED = (
    f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(abstract_raw, {literal(YEAR_PARENTHESIS)}, '', 'g'),"
    r" '\s+([,.;:])', '\1', 'g'), '\(\s*[;,]?\s*\)', '', 'g'), '[ \t]{2,}', ' ', 'g'), "
    + TRIM
    + ")"
)


@query("citations_stripped", f"WITH {DOCS} SELECT id, {STRIPPED} AS abstract FROM citing")
def citations_stripped(spark, sf_dir):
    return citing_documents(spark, sf_dir).select("id", strip_citations(F.col("abstract_raw")).alias("abstract"))


PHRASES = "'e.g., K. ' || n1 || ' van der ' || n2 || ' & ' || n3"


@query(
    "surname_keys",
    f"""WITH {DOCS}, phrased AS (
      SELECT doc_id, 'plain' AS form, n1 || '-' || n2 || ', ' || n3 AS phrase FROM named
      UNION ALL SELECT doc_id, 'initials', 'see also J.R. ' || n1 || ' et al.' FROM named
      UNION ALL SELECT doc_id, 'particles', 'cf. also: van der ' || n2 || ' and ' || n1 FROM named
      UNION ALL SELECT doc_id, 'text', text FROM named)
    SELECT doc_id, form, author_key FROM {surname_sql("phrased", "phrase")}""",
)
def surname_keys(spark, sf_dir):
    forms = {
        "plain": F.concat("n1", F.lit("-"), "n2", F.lit(", "), "n3"),
        "initials": F.concat(F.lit("see also J.R. "), "n1", F.lit(" et al.")),
        "particles": F.concat(F.lit("cf. also: van der "), "n2", F.lit(" and "), "n1"),
        "text": F.col("text"),
    }
    cases = F.array(*[F.struct(F.lit(k).alias("form"), v.alias("phrase")) for k, v in forms.items()])
    rows = named_documents(spark, sf_dir).select("doc_id", F.explode(cases).alias("c"))
    return rows.select("doc_id", F.col("c.form").alias("form"), surname_key(F.col("c.phrase")).alias("author_key"))


# ---- library ------------------------------------------------------------------------------
def library_items(spark, sf_dir):
    """Documents as library items; French ones carry a misspelt lead author, German ones no DOI.

    All names of a text are its authors, the third pick once more with a particle.
    """
    named = named_documents(spark, sf_dir)
    lead = F.when(F.col("lang") == "fr", F.concat(F.expr("substr(n1, 1, length(n1) - 1)"), F.lit("x"))).otherwise(F.col("n1"))
    return named.select(
        F.when(F.col("lang") == "en", F.lit("first")).otherwise(F.lit("second")).alias("assessment"),
        F.col("doc_id").cast("string").alias("key"),
        lead.alias("first_author"),
        F.concat(lead, F.lit("; van "), F.col("n3"), F.lit("; "), F.array_join("names", "; ")).alias("authors"),
        F.concat(F.col("y1"), F.lit("-03-01")).alias("year"),
        F.when(F.col("lang") != "de", F.concat(F.lit("https://doi.org/10.1234/ABC"), F.col("doc_id"))).alias("doi"),
        "doc_id",
    )


def known_ids(spark, sf_dir):
    """Ids by DOI; some DOIs have two, of which the first in order counts: that may be one that the corpus lacks."""
    number = F.col("doc_id")
    ids = F.array_compact(
        F.array(
            F.concat(F.lit("W"), number),
            F.when(number % 5 == 0, F.concat(F.lit("X"), number)),
            F.when(number % 7 == 0, F.concat(F.lit("V"), number)),
        )
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(ids).alias("id"), F.concat(F.lit("doi:10.1234/abc"), number).alias("doi"))


def corpus(spark, sf_dir):
    """Labelled documents: good ones under their work id, the others under their library id."""
    prefix = F.when(F.col("quality") == 1, F.lit("W")).otherwise(F.lit("zotero:"))
    return table(spark, sf_dir, "labels").select(F.concat(prefix, F.col("doc_id")).alias("id"))


def index(spark, sf_dir):
    # a stored table, as every pass reads it
    return cut_lineage(
        reference_index(
            library_items(spark, sf_dir), known_ids(spark, sf_dir), corpus(spark, sf_dir), ["doc_id"], ["id"]
        )
    )


def cited_places(spark, sf_dir, raw=False):
    """The citations of every document in a stored table, so no pass parses the texts again; the places' texts if asked for."""
    assessment = assessment_of(F.col("keyset"), {"en": "first"}, "second")
    places = citing_places(citing_documents(spark, sf_dir)).withColumn("assessment", assessment)
    return cut_lineage(places.withColumn("row", F.monotonically_increasing_id()) if raw else places.drop("places"))


def citations(spark, sf_dir):
    return citation_rows(cited_places(spark, sf_dir), raw=False)


INDEX = f"""{EXTRACTED},
  items AS (
    SELECT *, CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS assessment,
           CASE WHEN lang = 'fr' THEN substr(n1, 1, length(n1) - 1) || 'x' ELSE n1 END AS lead
    FROM named),
  corpus AS (
    SELECT DISTINCT CASE WHEN quality = 1 THEN 'W' ELSE 'zotero:' END || doc_id AS id FROM labels),
  placed AS (
    SELECT i.*, coalesce(w.id, z.id) AS corpus_id
    FROM items i LEFT JOIN corpus w ON i.lang <> 'de' AND i.doc_id % 7 <> 0 AND w.id = 'W' || i.doc_id
    LEFT JOIN corpus z ON z.id = 'zotero:' || i.doc_id
    WHERE coalesce(w.id, z.id) IS NOT NULL),
  authors AS (
    SELECT assessment, corpus_id, doc_id, y1 AS year, 0 AS pos, lead AS name FROM placed
    UNION ALL SELECT assessment, corpus_id, doc_id, y1, 1, 'van ' || n3 FROM placed
    UNION ALL SELECT assessment, corpus_id, doc_id, y1, 1 + generate_subscripts(names, 1), unnest(names) FROM placed),
  indexed AS (
    SELECT assessment, corpus_id, coalesce(author_key, {author_key_sql("name")}) AS author_key, CAST(year AS INT) AS year,
           pos = 0 AS is_first, min(struct_pack(d := doc_id, p := pos)) AS ordinal
    FROM {surname_sql("authors", "name")}
    WHERE coalesce(author_key, {author_key_sql("name")}) <> '' GROUP BY ALL),
  cites AS (SELECT *, CASE WHEN keyset = 'en' THEN 'first' ELSE 'second' END AS assessment FROM extracted),
  wanted AS (SELECT DISTINCT assessment, author_key, year FROM cites),
  strict AS (
    SELECT w.*, m.matched_id FROM wanted w LEFT JOIN (
      SELECT assessment, author_key, year, arg_min(corpus_id, ordinal) AS matched_id
      FROM indexed WHERE is_first GROUP BY ALL) m USING (assessment, author_key, year)),
  near AS (
    SELECT w.assessment, w.author_key, w.year, i.corpus_id, i.author_key AS ref_key, i.ordinal,
           levenshtein(w.author_key, i.author_key) AS d
    FROM strict w JOIN indexed i ON w.assessment = i.assessment AND abs(i.year - w.year) <= 1
    WHERE w.matched_id IS NULL AND abs(length(w.author_key) - length(i.author_key)) <= 2
      AND levenshtein(w.author_key, i.author_key) <= least(2, floor(length(i.author_key) / 3) + 1)),
  loose AS (
    SELECT assessment, author_key, year, corpus_id AS matched_id,
           round(1 - d / CAST(greatest(length(author_key), length(ref_key), 1) AS DOUBLE), 3) AS match_score
    FROM near QUALIFY row_number() OVER (PARTITION BY assessment, author_key, year ORDER BY d, ordinal) = 1),
  resolved AS (
    SELECT c.*, coalesce(s.matched_id, l.matched_id) AS matched_id,
           CASE WHEN s.matched_id IS NOT NULL THEN 'strict' WHEN l.matched_id IS NOT NULL THEN 'loose' ELSE 'unmatched' END AS match_pass,
           CASE WHEN s.matched_id IS NOT NULL THEN 1 ELSE l.match_score END AS match_score
    FROM cites c LEFT JOIN strict s USING (assessment, author_key, year)
    LEFT JOIN loose l USING (assessment, author_key, year))"""


@query("reference_index", f"WITH {INDEX} SELECT assessment, corpus_id, author_key, year, is_first FROM indexed")
def reference_index_rows(spark, sf_dir):
    return index(spark, sf_dir).drop("ordinal")


@query("strict_match", f"WITH {INDEX} SELECT assessment, author_key, year, matched_id FROM strict")
def strict_match(spark, sf_dir):
    wanted = citations(spark, sf_dir).select("assessment", "author_key", "year").distinct()
    return strict_matches(wanted, index(spark, sf_dir))


@query("loose_band_fuzzy_match", f"WITH {INDEX} SELECT assessment, author_key, year, matched_id, match_score FROM loose")
def loose_band_fuzzy_match(spark, sf_dir):
    wanted = citations(spark, sf_dir).select("assessment", "author_key", "year").distinct()
    refs = index(spark, sf_dir)
    return loose_matches(strict_matches(wanted, refs).filter("matched_id is null"), refs)


@query("resolve_citations", f"WITH {INDEX} SELECT * FROM resolved")
def resolved_citations(spark, sf_dir):
    return resolve_places(cited_places(spark, sf_dir, raw=True), index(spark, sf_dir))


@query(
    "match_summary_levels",
    f"""WITH {INDEX}
    SELECT level_order, match_pass, coalesce(n, 0) AS n
    FROM (VALUES (0, 'strict'), (1, 'loose'), (2, 'unmatched')) v(level_order, match_pass)
    LEFT JOIN (SELECT match_pass, count(*) AS n FROM resolved GROUP BY match_pass) USING (match_pass)""",
)
def match_summary_levels(spark, sf_dir):
    return match_summary(resolve_citations(citations(spark, sf_dir), index(spark, sf_dir)))


@query(
    "resolution_totals",
    f"""WITH {INDEX}
    SELECT count(*) AS n_citations, count(matched_id) AS n_resolved,
           round(100.0 * count(matched_id) / greatest(count(*), 1), 1) AS resolved_pct,
           count(DISTINCT matched_id) AS n_works FROM resolved""",
)
def resolution_total_row(spark, sf_dir):
    return resolution_totals(resolve_citations(citations(spark, sf_dir), index(spark, sf_dir)))
