"""HTML to text, and the full cleaning chain around it."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftlink.functions.text import blank_to_null, squish, strip_abstract_prefix, strip_latex


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _to_text(markup: str) -> str:
    if "<" not in markup and "&" not in markup:
        return markup
    parser = _Text()
    try:
        parser.feed(markup)
        parser.close()
    except Exception:
        return markup
    return "".join(parser.parts)


@F.pandas_udf(StringType())
def html_to_text(markup: pd.Series) -> pd.Series:
    """All text nodes in document order. Spark has no HTML parser, so this one step leaves the JVM."""
    return markup.map(_to_text, na_action="ignore")


# Equal input gives equal text; the mark keeps a filter on the result from parsing every page twice.
html_to_text = html_to_text.asNondeterministic()


def finish_clean(plain: Column, drop_prefix: bool = False) -> Column:
    """The steps after markup removal; no text left gives NULL."""
    body = strip_abstract_prefix(plain) if drop_prefix else plain
    return blank_to_null(squish(strip_latex(body)))


def without_markup(c: Column) -> Column:
    """Texts that hold no tag and no entity stay as they are; only the others leave the JVM."""
    return F.coalesce(html_to_text(F.when(c.rlike("[<&]"), c)), c)


def clean_title(c: Column) -> Column:
    return finish_clean(without_markup(c))


def clean_abstract(c: Column) -> Column:
    return finish_clean(without_markup(c), drop_prefix=True)
