import random

from weftlink.operators.checks import level_counts
from weftlink.operators.resolve import (
    match_summary,
    near_names,
    reference_index,
    resolution_totals,
    resolve_citations,
)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def cap(ref, most=2):
    return min(most, len(ref) // 3 + 1)


def test_near_names_finds_every_pair(spark):
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    cited, known = {name() for _ in range(150)}, {name() for _ in range(150)}
    as_rows = lambda names: spark.createDataFrame([("x", n) for n in names], "assessment string, author_key string")
    for most in (0, 1, 2, 3):
        got = {(r.author_key, r.ref_key, r.distance) for r in near_names(as_rows(cited), as_rows(known), most).collect()}
        assert got == {(c, k, edits(c, k)) for c in cited for k in known if edits(c, k) <= cap(k, most)}


def test_crowded_names_are_split(spark):
    """Names that share their first letters meet in parts; long names differ after the letters that deletions are made in."""
    from pyspark.sql import functions as F

    from weftlink.operators.resolve import deletion_keys

    rng = random.Random(3)
    name = lambda: "internationalabc" + "".join(rng.choice("abcdef") for _ in range(6))
    cited, known = {name() for _ in range(80)} | {"", "a", "ab"}, {name() for _ in range(400)} | {"b", "ba"}
    rows = lambda names: spark.createDataFrame([("x", n) for n in sorted(names)], "assessment string, author_key string")
    got = [(r.author_key, r.ref_key, r.distance) for r in near_names(rows(cited), rows(known), group=16).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(c, k, edits(c, k)) for c in cited for k in known if edits(c, k) <= cap(k)}
    most = rows({"z" * 200}).select(F.size(deletion_keys(F.col("author_key"), 2)).alias("n")).first().n
    assert most == 3 and len(set(rows({"abcdefghijklmnop"}).select(deletion_keys(F.col("author_key"), 2).alias("k")).first().k)) == 1 + 12 + 66


def library(spark):
    items = spark.createDataFrame(
        [
            (1, "a", "K1", "Kabber", "Kabber; van Delden", "1999", "https://doi.org/10.1/A"),
            (2, "a", "K1", "Repeat", "Repeat", "1999", None),
            (3, "a", "K2", "Lu", None, "2000-01", None),
            (4, "a", "K3", "Brown", "Brown", "2011", "10.1/gone"),
            (5, "a", "K4", "Braun", "J. Braun; Brown", "2012", "10.1/d"),
            (6, "b", "K5", "Brown", "Brown", "2011", "10.1/e"),
            (7, "a", "K6", "Brown", "Brown", "2012", "10.1/f"),
        ],
        "n int, assessment string, key string, first_author string, authors string, year string, doi string",
    )
    ids = spark.createDataFrame(
        [("W1", "10.1/a"), ("W4", "10.1/D"), ("W5", "10.1/e"), ("W6", "10.1/f"), ("W9", "10.1/gone")], "id string, doi string"
    )
    corpus = spark.createDataFrame([(i,) for i in ("W1", "W4", "W5", "W6", "zotero:K2", "zotero:K1")], "id string")
    return reference_index(items, ids, corpus, ["n"], ["id"])


def test_reference_index(spark):
    rows = {(r.assessment, r.corpus_id, r.author_key, r.year, r.is_first) for r in library(spark).collect()}
    assert rows == {
        ("a", "W1", "kabber", 1999, True),
        ("a", "W1", "vandelden", 1999, False),
        ("a", "zotero:K2", "lu", 2000, True),
        ("a", "W4", "braun", 2012, True),
        ("a", "W4", "brown", 2012, False),
        ("a", "W6", "brown", 2012, True),
        ("b", "W5", "brown", 2011, True),
    }


def test_resolution(spark):
    cites = spark.createDataFrame(
        [
            (1, "a", "kabeer", 1999),  # one edit
            (2, "a", "li", 2001),  # one edit, one year off
            (3, "a", "brown", 2012),  # exact lead author
            (4, "a", "brown", 2011),  # a year off: first in library order, lead author or not
            (5, "b", "brown", 2011),
            (6, "b", "kabeer", 1999),  # wrong library
            (7, "a", "ng", 2000),  # two edits on a two-letter name
            (8, "a", "kabeer", 1999),  # repeated citation
        ],
        "n int, assessment string, author_key string, year int",
    )
    resolved = resolve_citations(cites, library(spark))
    got = {r.n: (r.matched_id, r.match_pass, r.match_score) for r in resolved.collect()}
    assert got == {
        1: ("W1", "loose", 0.833),
        2: ("zotero:K2", "loose", 0.5),
        3: ("W6", "strict", 1.0),
        4: ("W4", "loose", 1.0),
        5: ("W5", "strict", 1.0),
        6: (None, "unmatched", None),
        7: (None, "unmatched", None),
        8: ("W1", "loose", 0.833),
    }
    assert [(r.match_pass, r.n) for r in match_summary(resolved).orderBy("level_order").collect()] == [
        ("strict", 2), ("loose", 4), ("unmatched", 2),
    ]
    assert tuple(resolution_totals(resolved).first()) == (8, 6, 75.0, 5)
    assert level_counts(cites, "assessment", ["c"]).first().n == 0


def test_long_parenthesis_is_held_once(spark):
    """A parenthesis of many citations is one text of its definition, and resolves as the rows that repeat it do."""
    from pyspark.sql import functions as F

    from weftlink.operators.resolve import citation_rows, citing_places, extract_citations, resolve_places

    names = ["Kabber" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(100)]
    group = "(" + "; ".join(f"{n}, 1999" for n in [*names, *names[:9]]) + ")"
    text = f"Lu (2000) and Lu (2000) {group} Kabber et al. (1999) {group} (1999) (no year)"
    docs = spark.createDataFrame(
        [("k", "1", "s", text), ("k", "2", None, None), ("k", None, "s", "Brown (2012)"), ("k", "1", "s", "")],
        "keyset string, id string, source_id string, abstract_raw string",
    )
    places = citing_places(docs)
    held = places.select(F.length(F.to_json("found")).alias("f"), F.length(F.to_json("places")).alias("p")).fillna(0)
    assert max(r.f + r.p for r in held.collect()) < 4 * len(text)  # every citation with its text: 100 times that
    rows = [tuple(r)[1:] for r in extract_citations(docs).collect()]
    one = [r for r in rows if r[0] == "1"]
    assert [r[3:] for r in one] == [("lu", 2000, 1), ("kabber", 1999, 2), *[(n.lower(), 1999, i) for i, n in enumerate(names, 3)]]
    assert [r[2] for r in one] == ["Lu (2000)", "Kabber et al. (1999)", *[group] * 100]
    assert [r for r in rows if r[0] is None] == [(None, "s", "Brown (2012)", "brown", 2012, 1)]
    marked = places.withColumns({"assessment": F.lit("a"), "row": F.monotonically_increasing_id()})
    got = resolve_places(marked, library(spark))
    cites = extract_citations(docs).withColumn("assessment", F.lit("a"))
    want = resolve_citations(cites, library(spark)).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 103
    assert citation_rows(places, raw=False).columns == ["keyset", "keypaper_id", "source_id", "place", "author_key", "year", "cite_seq"]


def test_long_runs_of_particles_and_names(spark):
    """A text that repeats a particle, a name or a qualifier thousands of times is matched without recursion."""
    from pyspark.sql import functions as F

    from weftlink.functions.citations import NARRATIVE, find_citations, narrative_pattern
    from weftlink.functions.names import ONLY_PARTICLES, RUN_ALONE, RUN_WITH_SURNAME, SURNAME_WITH_PARTICLES, leading_qualifiers, surname_key

    n = 5000
    texts = ["de " * n + "Haan (2004) and (" + "see also " * n + "Kabeer, 1999)", "Haan and " * n + "Kabeer (2001)", "la " * n]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(F.transform(find_citations(F.col("t")), lambda c: F.struct(c["author_key"], c["year"])), surname_key(F.col("t"))).collect()
    # the narrative names, then the parenthesis
    assert [(r[0], r[1]) for r in got[0][0]] == [("de" * n + "haan", 2004), ("kabeer", 1999)]
    assert [(r[0], r[1]) for r in got[1][0]] == [("haan", 2001)]
    assert got[2][0] == [] and got[2][1] == "la" * n + "na"

    rng = random.Random(4)
    parts = ["de", "della", "al", "van", "Haan", "O'Brien", "X", "and", "&", "et al.", "et al", "see", "cf.", "(2004)", "(1999", ",", "x"]
    some = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "  ", "", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    pairs = [
        (narrative_pattern(), NARRATIVE), (SURNAME_WITH_PARTICLES, RUN_WITH_SURNAME), (ONLY_PARTICLES, RUN_ALONE),
        (leading_qualifiers(), leading_qualifiers(again="*+")),
    ]
    rows = spark.createDataFrame([(t,) for t in some], "t string")
    for old, new in pairs:
        differ = F.regexp_extract_all("t", F.lit(old), F.lit(0)) != F.regexp_extract_all("t", F.lit(new), F.lit(0))
        assert rows.filter(differ).count() == 0
