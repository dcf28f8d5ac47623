"""Inline-citation grammar as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions.names import PARTICLE_ALTERNATIVES, PARTICLES, surname_key
from weftlink.functions.text import trim_ws

# ---- fixed values -------------------------------------------------------------------------
YEAR = "(1[6-9][0-9]{2}|20[0-9]{2})[a-z]?"
PARENTHESIS = r"\([^()]*\)"
YEAR_PARENTHESIS = rf"\([^()]*{YEAR}[^()]*\)"
# -------------------------------------------------------------------------------------------


def narrative_pattern(lead: str = "", repeat: str = "+", again: str = "*") -> str:
    """Capitalised names, joined by &, and or et al, before a parenthesised year.

    ``lead``, ``repeat`` and ``again`` do not change what matches, only how fast other places are given up and how much
    stack a run of particles or of names takes.
    """
    name = rf"(?:(?:{PARTICLE_ALTERNATIVES})\s+){again}[A-Z][A-Za-z'’.-]{repeat}"
    joined = rf"{name}(?:\s+(?:et\s+al\.?|&|and)\s+{name}){again}(?:\s+et\s+al\.?)?"
    return rf"{lead}({joined})\s*\(\s*{YEAR}\s*\)"


# A match starts with a capital or with the first letter of a particle, and a name is never cut short. Neither is a run of
# particles or names: what is given back starts with none of what must follow. Java takes such runs in a loop, others by
# recursion, and a text that repeats a particle some thousand times ends an executor.
NARRATIVE = narrative_pattern(lead="(?=[A-Z" + "".join(sorted({p[0] for p in PARTICLES})) + "])", repeat="++", again="*+")


def _dated_key(key: Column, year: Column) -> Column:
    """A name's key and its year in one string, NULL where either is missing; the key has letters alone."""
    return F.concat(key, year)


def _years(chunk: Column) -> Column:
    return F.regexp_extract_all(chunk, F.lit(YEAR), F.lit(1))


def _author_part(chunk: Column) -> Column:
    before = trim_ws(F.regexp_replace(chunk, rf"{YEAR}[^\n]*$", ""))
    return trim_ws(F.regexp_replace(before, "[,;]+$", ""))


def _narrative_keys(raw: Column) -> Column:
    return F.array(_dated_key(surname_key(F.regexp_extract(raw, NARRATIVE, 1)), F.regexp_extract(raw, NARRATIVE, 2)))


def _group_keys(group: Column) -> Column:
    """One key and year per author and year between the parentheses."""
    inner = F.regexp_replace(F.regexp_replace(group, r"\)$", ""), r"^\(", "")
    chunks = F.transform(F.split(inner, ";"), trim_ws)
    dated = F.filter(chunks, lambda c: c.rlike(YEAR))
    keyed = F.transform(dated, lambda c: F.struct(_years(c).alias("years"), _author_part(c).alias("author")))
    named = F.filter(keyed, lambda k: k["author"] != "")
    with_key = F.transform(
        named, lambda k: F.struct(k["years"].alias("years"), surname_key(k["author"]).alias("key"))
    )
    return F.flatten(F.transform(with_key, lambda k: F.transform(k["years"], lambda y: _dated_key(k["key"], y))))


def narrative_phrases(text: Column) -> Column:
    """``Surname et al. (2004)``: the different ones of a text in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NARRATIVE), F.lit(0)))


def dated_parentheses(text: Column) -> Column:
    """``(Kabeer, 1999; Manlosa, 2022)``: the different ones of a text in order of appearance."""
    groups = F.array_distinct(F.regexp_extract_all(text, F.lit(PARENTHESIS), F.lit(0)))
    return F.filter(groups, lambda g: g.rlike(YEAR))


def keys_of_places(narrative: Column, groups: Column) -> Column:
    """``place, dated`` of every citation in order, repeats at a place dropped: the places are the narrative phrases, then
    the parentheses, from 0 on. The places' texts are not repeated, as a long one may hold thousands of citations."""

    def at(first: Column, phrases: Column, keys) -> Column:
        found = F.transform(phrases, lambda raw: F.filter(F.array_distinct(keys(raw)), lambda d: d.isNotNull()))
        placed = F.transform(
            found, lambda ds, i: F.transform(ds, lambda d: F.struct((first + i).alias("place"), d.alias("dated")))
        )
        return F.flatten(placed)

    return F.concat(at(F.lit(0), narrative, _narrative_keys), at(F.size(narrative), groups, _group_keys))


def key_of(dated: Column) -> Column:
    return F.substring(dated, F.lit(1), F.length(dated) - 4)


def year_of(dated: Column) -> Column:
    return F.substring(dated, -4, 4).cast("int")


def find_citations(text: Column) -> Column:
    """All citations of a text, narrative ones first, repeats dropped, in order of appearance.

    Each carries the whole text of its place; where that may be long, use ``keys_of_places`` and look the texts up row by row.
    """
    narrative, groups = narrative_phrases(text), dated_parentheses(text)
    found = F.transform(
        keys_of_places(narrative, groups),
        lambda c: F.struct(
            F.get(F.concat(narrative, groups), c["place"]).alias("raw"),
            key_of(c["dated"]).alias("author_key"),
            year_of(c["dated"]).alias("year"),
        ),
    )
    return F.when(text.isNotNull(), found)


def strip_citations(text: Column) -> Column:
    """The text without year-bearing parentheses, tidied."""
    out = F.regexp_replace(text, YEAR_PARENTHESIS, "")
    out = F.regexp_replace(out, r"\s+([,.;:])", "$1")
    out = F.regexp_replace(out, r"\(\s*[;,]?\s*\)", "")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return trim_ws(out)
