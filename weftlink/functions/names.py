"""Author names to match keys, as JVM expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions.text import blank_to_null, trim_ws

# ---- fixed values -------------------------------------------------------------------------
PARTICLES = (
    "van", "von", "der", "den", "de", "del", "della", "dela", "di", "da",
    "das", "dos", "du", "la", "le", "les", "lo", "el", "al", "bin", "ibn",
    "ten", "ter", "st", "abu", "ben",
)
# The first alternative that fits wins: "following" hides the longer phrase at the end.
QUALIFIERS = (
    r"e\.?\s*g\.?", r"i\.?\s*e\.?", r"cf\.?", r"c\.?\s*f\.?", r"viz\.?",
    r"see\s+also", "see", r"but\s+see", "also", "following", r"reviewed\s+in", "sensu",
    r"based\s+on", r"adapted\s+from", r"modified\s+from", r"following\s+the\s+work\s+of",
)
LETTERS_WITHOUT_DECOMPOSITION = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T",
}
LETTER_PAIRS = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
INITIALS = r"^(?:[A-Z]\.?|(?:[A-Z]\.){1,3})$"
# -------------------------------------------------------------------------------------------


def _latin_letters() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode decomposition."""
    pairs = dict(LETTERS_WITHOUT_DECOMPOSITION)
    for point in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(point)
        base = unicodedata.normalize("NFKD", letter)[0]
        if base != letter and base.isascii() and base.isalpha():
            pairs[letter] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, UNACCENTED = _latin_letters()
PARTICLE_ALTERNATIVES = "|".join(PARTICLES)
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # \b also counts accented letters in Java


def leading_qualifiers(boundary: str = ASCII_BOUNDARY, again: str = "*") -> str:
    return r"(?i)^(?:[\s.,:;]+|(?:" + "|".join(QUALIFIERS) + rf"){boundary})" + again


AFTER_FIRST_AUTHOR = r"(?s)\s*(?:&|,| and | et al\.?).*$"
SURNAME_WITH_PARTICLES = rf"(?i)^(?:(?:{PARTICLE_ALTERNATIVES})\s)*\S+"
ONLY_PARTICLES = rf"(?i)^(?:(?:{PARTICLE_ALTERNATIVES})\s)*(?:{PARTICLE_ALTERNATIVES})$"
# the same for Java, where a run that may be given back takes a piece of stack for each particle
_PARTICLE_RUN = rf"(?i)^(?:(?:{PARTICLE_ALTERNATIVES})\s(?=\S))*+"
RUN_WITH_SURNAME = rf"{_PARTICLE_RUN}\S+"
RUN_ALONE = rf"{_PARTICLE_RUN}(?:{PARTICLE_ALTERNATIVES})$"


def fold_ascii(c: Column) -> Column:
    out = F.translate(c, ACCENTED, UNACCENTED)
    for letter, pair in LETTER_PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def author_key(c: Column) -> Column:
    """Lower-case ASCII letters of a name; NULL becomes the empty key."""
    return F.regexp_replace(F.lower(fold_ascii(F.coalesce(c, F.lit("")))), "[^a-z]", "")


def strip_qualifiers(c: Column) -> Column:
    return F.regexp_replace(c, leading_qualifiers(again="*+"), "")


def name_tokens(c: Column) -> Column:
    """Blank-separated parts of the first author, initials dropped unless nothing else is left."""
    first = trim_ws(F.regexp_replace(strip_qualifiers(trim_ws(c)), AFTER_FIRST_AUTHOR, ""))
    return F.filter(F.split(first, r"\s+"), lambda t: t != "")


def _surname(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t: ~t.rlike(INITIALS))
    # an author made of initials alone keeps the last one
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.slice(tokens, -1, 1))
    return F.array_join(kept, " ")


def _key_of_surname(name: Column) -> Column:
    # particles with no name behind them get the text of a missing value, as the source data has it
    head = F.when(name.rlike(RUN_ALONE), F.concat(name, F.lit(" na"))).otherwise(
        F.regexp_extract(name, RUN_WITH_SURNAME, 0)
    )
    return blank_to_null(author_key(head))


def _through(value: Column, step) -> Column:
    """Bind an intermediate value once, so later uses do not repeat its expression."""
    return F.element_at(F.transform(F.array(value), step), 1)


def surname_key(c: Column) -> Column:
    """Match key of the first surname in an author phrase, NULL when there is none."""
    tokens = name_tokens(c)
    key = _through(tokens, lambda t: F.when(F.size(t) > 0, _through(_surname(t), _key_of_surname)))
    return F.when(c.isNotNull(), key)


def reference_key(c: Column) -> Column:
    """The key of a library author: the surname key, else all letters of the name."""
    return F.coalesce(surname_key(c), author_key(c))
