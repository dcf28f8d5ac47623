"""Library sync by versions, id lookup with a pushed condition, and the rate shares of both."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from weftlink.config import Settings
from weftlink.operators.library import ids_by_chapter, item_rows, one_per_chapter
from weftlink.sources import paged
from weftlink.streaming.library import known_ids, merge_items, stored_or_none, sync_ids, sync_library
from weftlink.workflow import sync_libraries


def item(key, version, *chapters, title="T"):
    return {"key": key, "version": version, "data": {"key": key, "title": title, "DOI": f"10.1234/{key.lower()}", "tags": [{"tag": c} for c in chapters]}}


def serve(folder, version, items, deleted=None):
    for i in range(0, max(len(items), 1), paged.PAGE_ROWS):
        (folder / f"page-{i}.json").write_text(json.dumps(items[i : i + paged.PAGE_ROWS]))
    (folder / "total").write_text(str(len(items)))
    (folder / "version").write_text(str(version))
    (folder / "deleted.json").write_text(json.dumps(deleted or {}))


def test_second_sync_reads_only_changes(spark, tmp_path):
    pages, root = tmp_path / "pages", str(tmp_path / "library")
    pages.mkdir()
    many = [item(f"K{i}", 1, f"Chapter {i % 3}") for i in range(250)]
    serve(pages, 1, many)
    go = lambda: sync_library(spark, root, "lib", str(tmp_path / "ck"), "5", path=str(pages))
    path = go()
    full = {(r.key, r.chapter): r.title for r in stored_or_none(spark, path).collect()}
    assert len(full) == 250
    # one moves, one gets a second chapter, one is new, one leaves; all others keep their version
    changed = [item("K0", 2, "Chapter 9", title="moved"), item("K1", 3, "Chapter 1", "Chapter 2"), *many[2:249], item("N", 3)]
    serve(pages, 3, changed, {"2": ["K249"]})
    seen = []
    paged.register(spark)
    stream = paged._LibraryStream({"path": str(pages)})
    assert stream.latestOffset() == {"version": 3}
    for partition in stream.partitions({"version": 1}, {"version": 3}):
        seen += [(r[3], r[2] is None) for r in stream.read(partition)]
    assert sorted(seen) == [("K0", False), ("K1", False), ("K249", True), ("N", False)]
    # what changes after the batch was planned waits for the next
    late = [r[3] for p in stream.partitions({"version": 1}, {"version": 2}) for r in stream.read(p)]
    assert sorted(late) == ["K0", "K249"]
    for _ in range(2):  # the second time there is nothing new
        go()
        got = {(r.key, r.chapter): r.title for r in stored_or_none(spark, path).collect()}
        want = {k: v for k, v in full.items() if k[0] not in ("K0", "K249")}
        assert got == want | {("K0", "Chapter 9"): "moved", ("K1", "Chapter 2"): "T", ("N", "No Chapter"): "T"}
    # a whole download of the same pages gives the same rows
    again = spark.read.format("library").option("group", "5").option("path", str(pages)).load()
    rows = one_per_chapter(item_rows(again.drop("key", "version"), "5"), ["page", "position"])
    assert {(r.key, r.chapter) for r in rows.collect()} == set(got)


def test_a_chapter_that_empties_is_gone_and_replays_change_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "page int, position int, item string, key string, version long"
    rows = lambda *items: spark.createDataFrame([(0, n, json.dumps(i), i["key"], i["version"]) for n, i in enumerate(items)], schema)
    merge_items(rows(item("A", 1, "Chapter a"), item("B", 1, "Chapter b/c=1")), path, "5")
    gone = spark.createDataFrame([(-1, 0, None, "B", 3), (0, 0, json.dumps(item("A", 2, "Chapter a", title="old")), "A", 2)], schema)
    twice = gone.unionByName(rows(item("A", 3, "Chapter z", title="new")))
    for _ in range(2):
        merge_items(twice, path, "5")
        assert [(r.key, r.chapter, r.title) for r in stored_or_none(spark, path).collect()] == [("A", "Chapter z", "new")]


def test_ids_are_asked_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(dois):
        (asked / str(len(list(asked.iterdir())))).write_text(json.dumps(dois))
        return [{"id": f"W-{d}", "doi": f"https://doi.org/{d}"} for d in dois if d != "10.1234/none"]

    rows = [("1", "10.1234/A"), ("2", "https://doi.org/10.1234/a"), ("2", "10.1234/none"), ("3", None)]
    library = spark.createDataFrame(rows, "chapter string, doi string")
    path = str(tmp_path / "ids")
    assert (sync_ids(library, path, fetch, 1), sync_ids(library, path, fetch, 1)) == (2, 0)
    more = library.unionByName(spark.createDataFrame([("4", "10.1234/b")], library.schema))
    assert sync_ids(more, path, fetch, 1) == 1
    assert sorted(d for f in asked.iterdir() for d in json.loads(f.read_text())) == ["10.1234/a", "10.1234/b", "10.1234/none"]
    found = ids_by_chapter(more, known_ids(spark, path)).collect()
    assert sorted(tuple(r) for r in found) == [("1", "W-10.1234/a", "10.1234/a"), ("2", "W-10.1234/a", "10.1234/a"), ("4", "W-10.1234/b", "10.1234/b")]


def test_libraries_are_a_step(spark, tmp_path):
    for label in ("a", "b"):
        (tmp_path / label).mkdir()
        serve(tmp_path / label, 1, [item("K", 1, "Chapter 1"), item(label, 1)])
    specs = {label: {"group": n, "path": str(tmp_path / label)} for n, label in enumerate(("a", "b"))}
    fetch = lambda dois: [{"id": f"W-{d}", "doi": d} for d in dois]
    library, ids = sync_libraries(spark, str(tmp_path / "out"), Settings("m", {}, specs, workers=1), fetch)
    want = [("a", "Chapter 1", "K"), ("a", "No Chapter", "a"), ("b", "Chapter 1", "K"), ("b", "No Chapter", "b")]
    assert sorted((r.assessment, r.chapter, r.key) for r in library.collect()) == want
    assert sorted(r.id for r in ids.collect()) == ["W-10.1234/a", "W-10.1234/b", "W-10.1234/k"]


def test_conditions_on_doi_become_requests(spark, tmp_path, capsys):
    (tmp_path / "known.json").write_text(json.dumps({f"10.1234/{i}": f"W{i}" for i in range(200)}))
    paged.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        works = spark.read.format("work_ids").option("path", str(tmp_path / "known.json")).load()
        some = works.filter(F.col("doi").isin([f"10.1234/{i}" for i in range(120)] + ["10.1234/no"]) & F.col("id").endswith("7"))
        assert sorted(r.id for r in some.collect()) == sorted(f"W{i}" for i in range(120) if i % 10 == 7)
        assert some.rdd.getNumPartitions() == 3  # fifty DOIs a request
        some.explain()
        plan = capsys.readouterr().out
        # Spark is left with the condition that the source does not take
        assert "BatchScan work_ids" in plan and "EndsWith(id" in plan and " IN (" not in plan and "isnotnull(doi" not in plan
        assert [r.id for r in works.filter("doi = '10.1234/5'").collect()] == ["W5"]
        with pytest.raises(Exception, match="doi IN"):
            spark.read.format("work_ids").load().collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_lanes_share_the_rate(monkeypatch):
    assert paged.lanes(0) == [[]] and paged.lanes(101) == [[0], [100]]
    assert sorted(s for lane in paged.lanes(1000) for s in lane) == list(range(0, 1000, 100)) and len(paged.lanes(1000)) == paged.LANES
    now, asked = [0.0], []
    monkeypatch.setattr(paged.time, "monotonic", lambda: now[0])
    monkeypatch.setattr(paged.time, "sleep", lambda s: now.__setitem__(0, now[0] + s))

    def urlopen(request, timeout):
        asked.append(now[0])
        if len(asked) == 2:
            raise urllib.error.HTTPError(request.full_url, 429, "busy", {"Retry-After": "7"}, io.BytesIO())
        answer = io.BytesIO(b"[]")
        answer.headers = {"Total-Results": "3", "Last-Modified-Version": "9"}
        return answer

    monkeypatch.setattr(paged.urllib.request, "urlopen", urlopen)
    pages = paged.HttpPages("5", "k", paged.REQUESTS_PER_SECOND / 4)
    assert pages.head() == (3, 9) and pages.page(0) == [] and pages.page(100, 4) == []
    assert len(asked) == 4 and all(b - a >= 4 / paged.REQUESTS_PER_SECOND for a, b in zip(asked, asked[1:])) and asked[2] - asked[1] >= 7
