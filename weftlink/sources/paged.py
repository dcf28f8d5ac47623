"""Paged JSON sources: a reference-library group, and id lookup by DOI.

Pages are dealt to a few input partitions, so tasks fetch them in parallel within the service's rate. ``path`` reads
the same pages from files ``page-<start>.json`` and a ``total`` file instead, for work without a network.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

# ---- fixed values -------------------------------------------------------------------------
LIBRARY_API = "https://api.zotero.org/groups"
PAGE_ROWS = 100
REQUESTS_PER_SECOND = 5
WORKS_API = "https://api.openalex.org/works"
DOIS_PER_REQUEST, WORKS_PER_PAGE = 50, 200
# -------------------------------------------------------------------------------------------


#: Partitions that ask the service at the same time; each has its share of the rate.
LANES = 4


class HttpPages:
    """A group's items from the service, at no more than ``share`` requests a second from one reader."""

    def __init__(self, group: str, key: str | None = None, share: float = REQUESTS_PER_SECOND) -> None:
        self.group, self.key, self.wait, self.last = group, key, 1 / share, 0.0

    def _ask(self, what: str, query: dict, retries: int = 5):
        """A JSON answer and its headers; a busy server says how long to wait, other failures wait longer each time."""
        url = f"{LIBRARY_API}/{self.group}/{what}?{urllib.parse.urlencode({**query, 'format': 'json'})}"
        headers = {"Zotero-API-Key": self.key} if self.key else {}
        for attempt in range(retries):
            time.sleep(max(0.0, self.last + self.wait - time.monotonic()))
            self.last = time.monotonic()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                    body, said = json.loads(answer.read()), dict(answer.headers)
                self.last += float(said.get("Backoff") or 0)
                return body, said
            except OSError as error:
                code = getattr(error, "code", 500)
                if attempt + 1 == retries or code not in (429, 500, 502, 503, 504):
                    raise
                asked = (getattr(error, "headers", None) or {}).get("Retry-After")
                time.sleep(float(asked) if asked and asked.isdigit() else 2**attempt)
        raise AssertionError("unreachable")

    def head(self, since: int = 0) -> tuple[int | None, int]:
        """How many items changed after a version of the library (None: not said), and its version now."""
        _, said = self._ask("items/top", {"limit": 1, "since": since})
        total = said.get("Total-Results", "")
        return (int(total) if total.isdigit() else None), int(said.get("Last-Modified-Version") or 0)

    def page(self, start: int, since: int = 0) -> list[dict]:
        return self._ask("items/top", {"limit": PAGE_ROWS, "start": start, "since": since})[0]

    def deleted(self, since: int) -> list[str]:
        return self._ask("deleted", {"since": since})[0].get("items", [])


class FilePages:
    """The same from files a service would have sent: ``page-<start>.json``, ``total``, and for changes ``version`` and ``deleted.json``.

    ``deleted.json`` maps a version to the keys that left with it. For drivers and executors that share the folder.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def _read(self, name: str, default: str | None = None) -> str:
        full = os.path.join(self.path, name)
        if default is not None and not os.path.exists(full):
            return default
        with open(full, encoding="utf-8") as f:
            return f.read().strip()

    def _changed(self, since: int) -> list[dict]:
        total = int(self._read("total"))
        items = [i for start in range(0, total, PAGE_ROWS) for i in json.loads(self._read(f"page-{start}.json"))]
        return [i for i in items if i.get("version", 0) > since]

    def head(self, since: int = 0) -> tuple[int | None, int]:
        version = int(self._read("version", "0"))
        if since:
            return len(self._changed(since)), version
        total = self._read("total")
        return (int(total) if total.isdigit() else None), version

    def page(self, start: int, since: int = 0) -> list[dict]:
        return self._changed(since)[start : start + PAGE_ROWS] if since else json.loads(self._read(f"page-{start}.json"))

    def deleted(self, since: int) -> list[str]:
        return [k for version, keys in json.loads(self._read("deleted.json", "{}")).items() if int(version) > since for k in keys]


def _pages(options: dict, share: float = REQUESTS_PER_SECOND):
    return FilePages(options["path"]) if options.get("path") else HttpPages(options.get("group"), options.get("key"), share)


def lanes(total: int, lanes_at_most: int = LANES) -> list[list[int]]:
    """First rows of all pages, dealt to so many partitions at most: each asks for its pages one after another."""
    starts = list(range(0, total, PAGE_ROWS))
    n = max(1, min(lanes_at_most, len(starts)))
    return [starts[i::n] for i in range(n)]


class LibrarySource(DataSource):
    """Top-level items of one group. Options: ``group``, optional ``key``, optional ``path`` (pages in files).

    Read at once, it gives every item. Read as a stream, its offsets are versions of the library, so a batch holds the
    items that changed since the one before, and the keys of those that are gone (``item`` null).
    Pages are dealt to a few partitions that share the service's rate, however many run at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return "page int, position int, item string, key string, version long"

    def reader(self, schema) -> DataSourceReader:
        return _LibraryReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _LibraryStream({k.lower(): v for k, v in self.options.items()})


def _rows(page: int, items: list[dict], after: int = 0, until: int | None = None) -> Iterator[tuple]:
    for position, item in enumerate(items):
        version = int(item.get("version", 0))
        # what changed after the batch was planned belongs to the next one
        if until is None or after < version <= until:
            yield page, position, json.dumps(item), item.get("key") or (item.get("data") or {}).get("key"), version


class _LibraryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        total, _ = _pages(self.options).head()
        if not total:
            raise ValueError(f"group {self.options.get('group')}: no result count or no items")
        dealt = lanes(total)
        return [InputPartition((starts, len(dealt))) for starts in dealt]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        starts, of = partition.value
        pages = _pages(self.options, REQUESTS_PER_SECOND / of)
        for start in starts:
            yield from _rows(start // PAGE_ROWS, pages.page(start))


class _LibraryStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": _pages(self.options).head()[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, until = int(start["version"]), int(end["version"])
        if until <= after:
            return []
        total, _ = _pages(self.options).head(after)
        dealt = lanes(total or 0)
        gone = [InputPartition((None, after, until, len(dealt) + 1))] if after else []
        return [InputPartition((starts, after, until, len(dealt) + len(gone))) for starts in dealt if starts] + gone

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        starts, after, until, of = partition.value
        pages = _pages(self.options, REQUESTS_PER_SECOND / of)
        if starts is None:
            for position, key in enumerate(pages.deleted(after)):
                yield -1, position, None, key, until
            return
        for start in starts:
            yield from _rows(start // PAGE_ROWS, pages.page(start, after), after, until)


class WorkIds(DataSource):
    """``id, doi`` of works by DOI: ``doi = ...`` and ``doi IN (...)`` become requests.

    Options: optional ``path`` with a JSON file that maps DOIs to ids, for work without a network. Without such a condition
    a read fails: the service holds every work there is. Needs ``spark.sql.python.filterPushdown.enabled``; load it anew
    for each question, as Spark keeps the conditions it has pushed with the loaded frame.
    """

    @classmethod
    def name(cls) -> str:
        return "work_ids"

    def schema(self) -> str:
        return "id string, doi string"

    def reader(self, schema) -> DataSourceReader:
        return _WorkIdReader(self.options.get("path"))


class _WorkIdReader(DataSourceReader):
    def __init__(self, path: str | None) -> None:
        self.path, self.dois = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("doi",):
                self.dois = values if self.dois is None else self.dois & values
            else:
                yield f  # Spark applies it to what comes back

    def partitions(self) -> list[InputPartition]:
        if self.dois is None:
            raise ValueError("ids are looked up by doi: ask with doi = ... or doi IN (...)")
        dois = sorted(d for d in self.dois if d)
        return [InputPartition(dois[i : i + DOIS_PER_REQUEST]) for i in range(0, len(dois), DOIS_PER_REQUEST)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.path:
            with open(self.path, encoding="utf-8") as f:
                known = json.load(f)
            found = [{"id": known[d], "doi": d} for d in partition.value if d in known]
        else:
            found = fetch_ids(partition.value)
        wanted = set(partition.value)
        for row in found:
            # the service answers with whole addresses; a row must meet the condition that was pushed
            doi = re.sub("^https?://(dx[.])?doi[.]org/", "", row["doi"].lower())
            if doi in wanted:
                yield row["id"], doi


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LibrarySource)
    spark.dataSource.register(WorkIds)


def get_json(url: str, retries: int = 4) -> dict:
    """A JSON answer; busy servers and lost connections are tried again, the last failure is raised."""
    for attempt in range(retries):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return json.loads(answer.read())
        except OSError as error:
            if attempt + 1 == retries or getattr(error, "code", 500) not in (429, 500, 502, 503, 504):
                raise
            time.sleep(2**attempt)
    raise AssertionError("unreachable")


def fetch_ids(dois: list[str], get=get_json) -> list[dict]:
    """``id, doi`` of all works with these DOIs, page after page.

    A DOI with a separator of the filter's own, a comma or a bar, is asked for alone.
    """
    alone = [d for d in dois if "," in d or "|" in d]
    found: list[dict] = []
    for group in [[d for d in dois if d not in alone], *([d] for d in alone)]:
        cursor: str | None = "*"
        while group and cursor:
            wanted = "|".join(urllib.parse.quote(d, safe="/:") if group[0] in alone else d for d in group)
            query = {"filter": f"doi:{wanted}", "select": "id,doi", "per-page": WORKS_PER_PAGE, "cursor": cursor}
            page = get(f"{WORKS_API}?{urllib.parse.urlencode(query)}")
            found += page["results"]
            cursor = page.get("meta", {}).get("next_cursor") if page["results"] else None
    return found


def lookup_ids(library: DataFrame, fetch=fetch_ids, workers: int = 8) -> DataFrame:
    """``id, doi`` for every distinct DOI of a library, looked up in batches by ``workers`` tasks.

    With a snapshot table of works at hand, ``operators.library.ids_by_chapter`` joins it instead.
    """
    from weftlink.functions.text import extract_doi

    dois = library.select(extract_doi(F.col("doi")).alias("doi")).filter("doi != ''").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            values = rows["doi"].tolist()
            for i in range(0, len(values), DOIS_PER_REQUEST):
                found = fetch(values[i : i + DOIS_PER_REQUEST])
                yield pd.DataFrame(found, columns=["id", "doi"])

    return dois.repartition(workers).mapInPandas(run, "id string, doi string")
