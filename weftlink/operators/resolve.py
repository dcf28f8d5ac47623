"""Inline citations to library works: an exact pass, then a fuzzy one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions.citations import dated_parentheses, key_of, keys_of_places, narrative_phrases, year_of
from weftlink.functions.names import reference_key
from weftlink.functions.text import blank_to_null, norm_doi, trim_ws, year_int
from weftlink.operators.checks import level_counts
from weftlink.plans.ordering import first_rows

# ---- fixed values -------------------------------------------------------------------------
PASSES = ["strict", "loose", "unmatched"]
LIBRARY_ID_PREFIX = "zotero:"
LOOSE_MAX_DISTANCE = 2
LOOSE_YEAR_WINDOW = 1
# -------------------------------------------------------------------------------------------

#: Letters of a name that deletions are made in; the rest is compared only when the names meet.
LED_BY = 12
#: Reference names of one key that a task holds.
NAMES_IN_GROUP = 256


def citing_places(definitions: DataFrame, text: str = "abstract_raw") -> DataFrame:
    """One row per definition: ``places``, the texts that cite, and ``found``, the citations with the number of their place.

    A place's text is held once however many citations it has.
    """
    rows = definitions.select(
        "keyset", "id", "source_id",
        narrative_phrases(F.col(text)).alias("_narrative"), dated_parentheses(F.col(text)).alias("_groups"),
    )
    return rows.select(
        "keyset", F.col("id").alias("keypaper_id"), "source_id", F.concat("_narrative", "_groups").alias("places"),
        keys_of_places(F.col("_narrative"), F.col("_groups")).alias("found"),
    )


def citation_rows(places: DataFrame, raw: bool = True) -> DataFrame:
    """One row per citation of ``citing_places``, numbered in order from 1, with all other columns.

    With ``raw`` it carries the text of its place, made here row by row; without, the number of the place.
    """
    own = [c for c in places.columns if c not in ("places", "found")]
    kept = [*own, "places"] if raw else own
    # the outer form: a plain explode would filter on the array first and parse every text again
    rows = places.select(*kept, F.posexplode_outer("found").alias("pos", "c")).filter("pos is not null")
    return rows.select(
        *own,
        F.get("places", F.col("c.place")).alias("raw_citation") if raw else F.col("c.place").alias("place"),
        key_of(F.col("c.dated")).alias("author_key"),
        year_of(F.col("c.dated")).alias("year"),
        (F.col("pos") + 1).alias("cite_seq"),
    )


def extract_citations(definitions: DataFrame, text: str = "abstract_raw") -> DataFrame:
    """One row per citation token of each definition, numbered in order from 1."""
    return citation_rows(citing_places(definitions, text)).select(
        "keyset", "keypaper_id", "source_id", "raw_citation", "author_key", "year", "cite_seq"
    )


def assessment_of(keyset: Column, exceptions: dict[str, str], default: str) -> Column:
    """The library a keyset cites: a named exception, else the default one."""
    out = F.lit(default)
    for name, assessment in exceptions.items():
        out = F.when(keyset == name, F.lit(assessment)).otherwise(out)
    return out


def _spread(value: Column, fallback: Column) -> Column:
    """A join key that matches nothing where ``value`` is missing.

    Missing values would all meet in one task; a key of their own spreads them.
    """
    return F.coalesce(value, F.concat(F.lit(" "), fallback))


def doi_ids(ids: DataFrame, order: list[str]) -> DataFrame:
    """First id per normalised DOI: ``ndoi, id``."""
    rows = ids.withColumn("ndoi", norm_doi(F.col("doi"))).filter((F.col("ndoi") != "") & F.col("id").isNotNull())
    return first_rows(rows.select("ndoi", *dict.fromkeys([*order, "id"])), ["ndoi"], order).select("ndoi", "id")


def corpus_ids_of(library: DataFrame, ids: DataFrame, corpus: DataFrame, ids_order: list[str]) -> DataFrame:
    """``corpus_id`` per library item: the DOI's id if the corpus has it, else the item's own id if
    the corpus has that, else the item is dropped."""
    known = corpus.select("id").distinct()
    by_doi = doi_ids(ids, ids_order).join(known, "id", "left_semi").withColumnRenamed("id", "doi_id")
    doi = blank_to_null(norm_doi(F.col("doi")))
    own = known.filter(F.col("id").startswith(LIBRARY_ID_PREFIX)).toDF("own_id")
    return (
        library.withColumn("_doi", _spread(doi, F.col("key")))
        .join(by_doi.withColumnRenamed("ndoi", "_doi"), "_doi", "left")
        .withColumn("_own", F.concat(F.lit(LIBRARY_ID_PREFIX), F.col("key")))
        .join(own, F.col("_own") == F.col("own_id"), "left")
        .withColumn("corpus_id", F.coalesce("doi_id", "own_id"))
        .filter(F.col("corpus_id").isNotNull())
        .drop("_doi", "doi_id", "_own", "own_id")
    )


def reference_index(
    library: DataFrame, ids: DataFrame, corpus: DataFrame, order: list[str], ids_order: list[str]
) -> DataFrame:
    """``assessment, corpus_id, author_key, year, is_first, ordinal``: one row per author of a work.

    ``order`` fixes which of several library rows counts as first; it becomes the ordinal.
    """
    fields = ["assessment", "key", "first_author", "authors", "year", "doi"]
    items = first_rows(library.select(*dict.fromkeys([*fields, *order])), ["assessment", "key"], order)
    items = corpus_ids_of(items, ids, corpus, ids_order).withColumn("year", year_int(F.col("year")))
    listed = F.transform(F.split("authors", ";"), trim_ws)
    names = F.when(blank_to_null(F.col("authors")).isNotNull(), listed).otherwise(F.array("first_author"))
    authors = items.withColumn("names", F.filter(names, lambda a: a.isNull() | (a != ""))).select(
        "assessment", "corpus_id", "year", F.struct(*order).alias("item"), F.posexplode("names").alias("pos", "name")
    )
    keyed = authors.select(
        "assessment",
        "corpus_id",
        reference_key(F.col("name")).alias("author_key"),
        "year",
        (F.col("pos") == 0).alias("is_first"),
        F.struct("item", "pos").alias("ordinal"),
    ).filter((F.col("author_key") != "") & F.col("year").isNotNull())
    return keyed.groupBy("assessment", "corpus_id", "author_key", "year", "is_first").agg(
        F.min("ordinal").alias("ordinal")
    )


def _first_work(index: DataFrame) -> DataFrame:
    return index.groupBy("assessment", "author_key", "year").agg(
        F.min(F.struct("ordinal", "corpus_id")).alias("work")
    )


def strict_matches(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``matched_id`` where lead author and year agree exactly, NULL elsewhere."""
    leads = _first_work(index.filter("is_first")).withColumn("matched_id", F.col("work.corpus_id")).drop("work")
    return wanted.join(leads, ["assessment", "author_key", "year"], "left")


def distance_cap(length: Column, max_distance: int) -> Column:
    """Edits allowed against a reference surname of this length."""
    return F.least(F.lit(max_distance), F.floor(length / 3) + 1).cast("int")


def deletion_keys(name: Column, most: int) -> Column:
    """Hashes of what is left of a name's first letters when up to ``most`` of them are deleted."""

    def shorter(v: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
        return F.when(F.length(v) > 0, cuts).otherwise(F.array().cast("array<string>"))

    level = F.array(F.substring(name, 1, LED_BY))
    levels = [level]
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        levels.append(level)
    return F.transform(F.array_distinct(F.concat(*levels)), lambda v: F.xxhash64(v))


def near_names(
    cited: DataFrame, known: DataFrame, max_distance: int = LOOSE_MAX_DISTANCE, group: int = NAMES_IN_GROUP
) -> DataFrame:
    """Pairs of distinct names within the allowed edits: ``assessment, author_key, ref_key, distance``.

    Two names within k edits become equal by deleting k letters at most of each, and so do their first letters. So
    an equi-join on what deletions leave of the first ``LED_BY`` letters finds every such pair; what remains is nearly the whole
    name, so few others meet. A remainder that more than about ``group`` reference names share is split by a hash of
    the reference name, and the cited names are copied to its parts: no task gets it whole. Rows are dealt by number: they
    are few bytes but make many keys and pairs, so tasks merged by their size would do too much.
    """
    tasks = int(cited.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refs = known.select("assessment", F.col("author_key").alias("ref_key")).distinct().repartition(tasks, "ref_key")
    refs = refs.select("assessment", "ref_key", F.explode(deletion_keys(F.col("ref_key"), max_distance)).alias("v"))
    probes = cited.select("assessment", "author_key").distinct().repartition(tasks, "author_key")
    probes = probes.select("assessment", "author_key", F.explode(deletion_keys(F.col("author_key"), max_distance)).alias("v"))
    parts = F.ceil(F.col("n") / group).cast("int")
    crowded = refs.groupBy("assessment", "v").agg(F.count("*").alias("n")).filter(F.col("n") > group)
    crowded = crowded.select("assessment", "v", parts.alias("parts"))
    key = ["assessment", "v"]
    refs = refs.join(crowded, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("ref_key"), F.col("parts")), F.lit(0)).cast("int"))
    probes = probes.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    probes, refs = (rows.drop("parts").repartition(tasks, *key, "part") for rows in (probes, refs))
    pairs = probes.join(refs, [*key, "part"])
    # a pair meets at several remainders; lengths say at once that most of the others are too far apart
    pairs = pairs.filter(F.abs(F.length("author_key") - F.length("ref_key")) <= distance_cap(F.length("ref_key"), max_distance))
    pairs = pairs.select("assessment", "author_key", "ref_key").distinct()
    distance = F.levenshtein(F.col("author_key"), F.col("ref_key"), max_distance)
    near = pairs.withColumn("distance", distance)
    return near.filter((F.col("distance") >= 0) & (F.col("distance") <= distance_cap(F.length("ref_key"), max_distance)))


def loose_matches(
    wanted: DataFrame,
    index: DataFrame,
    max_distance: int = LOOSE_MAX_DISTANCE,
    year_window: int = LOOSE_YEAR_WINDOW,
) -> DataFrame:
    """Best near name within the year window: any author, fewest edits, then library order."""
    works = _first_work(index).withColumnsRenamed({"author_key": "ref_key", "year": "ref_year"})
    near = near_names(wanted, index, max_distance)
    years = F.explode(F.sequence(F.col("year") - year_window, F.col("year") + year_window))
    best = (
        wanted.select("assessment", "author_key", "year")
        .join(near, ["assessment", "author_key"])
        .withColumn("ref_year", years)
        .join(works, ["assessment", "ref_key", "ref_year"])
        .groupBy("assessment", "author_key", "year")
        .agg(F.min(F.struct("distance", "work", "ref_key")).alias("best"))
    )
    longest = F.greatest(F.length("author_key"), F.length("best.ref_key"), F.lit(1))
    return best.select(
        "assessment",
        "author_key",
        "year",
        F.col("best.work.corpus_id").alias("matched_id"),
        F.round(1 - F.col("best.distance") / longest, 3).alias("match_score"),
    )


def resolve_citations(
    cites: DataFrame,
    index: DataFrame,
    max_distance: int = LOOSE_MAX_DISTANCE,
    year_window: int = LOOSE_YEAR_WINDOW,
) -> DataFrame:
    """Every citation with ``matched_id, match_pass, match_score``; unresolved ones stay, with NULLs.

    Each distinct (library, name, year) is resolved once however often it is cited.
    """
    key = ["assessment", "author_key", "year"]
    wanted = cites.select(*key).distinct()
    strict = strict_matches(wanted, index)
    hits = strict.filter("matched_id is not null").select(
        *key, "matched_id", F.lit(1.0).alias("match_score"), F.lit(PASSES[0]).alias("match_pass")
    )
    loose = loose_matches(strict.filter("matched_id is null"), index, max_distance, year_window).withColumn(
        "match_pass", F.lit(PASSES[1])
    )
    found = hits.unionByName(loose)
    return cites.join(found, key, "left").withColumn("match_pass", F.coalesce("match_pass", F.lit(PASSES[2])))


def resolve_places(
    places: DataFrame,
    index: DataFrame,
    max_distance: int = LOOSE_MAX_DISTANCE,
    year_window: int = LOOSE_YEAR_WINDOW,
) -> DataFrame:
    """``resolve_citations`` of stored ``citing_places`` with an ``assessment`` and a ``row`` that no other definition has.

    Citations are resolved and shuffled without the texts of their places, which join at the end, one row per definition.
    """
    resolved = resolve_citations(citation_rows(places, raw=False), index, max_distance, year_window)
    return resolved.join(places.select("row", "places"), "row", "left").select(
        "assessment", "author_key", "year", "keyset", "keypaper_id", "source_id",
        F.get("places", F.col("place")).alias("raw_citation"),
        "cite_seq", "matched_id", "match_score", "match_pass",
    )


def match_summary(resolved: DataFrame) -> DataFrame:
    """Citations per pass, in fixed order, passes without any included."""
    return level_counts(resolved, "match_pass", PASSES)


def resolution_totals(resolved: DataFrame) -> DataFrame:
    """Citations, share resolved and distinct works cited."""
    done = F.count_if(F.col("matched_id").isNotNull())
    return resolved.agg(
        F.count("*").alias("n_citations"),
        done.alias("n_resolved"),
        F.round(100 * done / F.greatest(F.count("*"), F.lit(1)), 1).alias("resolved_pct"),
        F.countDistinct("matched_id").alias("n_works"),
    )
