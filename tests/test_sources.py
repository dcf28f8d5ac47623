import collections
import json
import math
import os
import urllib.parse
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlink.config import load_settings
from weftlink.operators.definitions import SheetMap
from weftlink.operators.embedding import HashBackend, embed_works, http_backend, leaf_path, title_abstract_text, variant_preprocessor
from weftlink.operators.figures import cell_style
from weftlink.operators.library import item_rows, one_per_chapter
from weftlink.operators.topics import TopicSettings, assign_all, topic_info, topic_terms, top_words
from weftlink.report.pages import download_line, index_page, report_page, save_figure
from weftlink.report.svg import matrix_svg, pair_grid_svg
from weftlink.sources import paged, xlsx
from weftlink.sources.parquet import read_tree, rebuild, replace_partitions, unpack_vectors
from weftlink.streaming.incremental import embed_arrivals, progress_line
from weftlink.workflow import input_mark, link_definitions, settings_mark

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_book(path):
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {NS} {REL}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>ID</t></si><si><r><t>Text </t></r><r><t>definition</t></r></si></sst>")
        book.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
            '<row r="2"><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>hello</t></is></c></row>'
            '<row r="3"/><row r="4"><c r="C4" t="inlineStr"><is><t>only</t></is></c></row></sheetData></worksheet>',
        )


def test_sheet_source(spark, tmp_path):
    write_book(tmp_path / "a.xlsx")
    xlsx.register(spark)
    df = spark.read.format("sheet").option("sheet", "One").load(str(tmp_path / "a.xlsx"))
    assert df.columns == ["ID", "column2", "Text definition"]
    assert [tuple(r) for r in df.collect()] == [("7", None, "hello"), (None, None, "only")]
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("sheet").option("sheet", "Two").load(str(tmp_path / "a.xlsx")).collect()


def write_columns(path, names, rows):
    write_book(path)
    cell = lambda i, r, v: f'<c r="{"ABC"[i]}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    lines = [f'<row r="{r}">{"".join(cell(i, r, v) for i, v in enumerate(row) if v)}</row>' for r, row in enumerate([names, *rows], 1)]
    with zipfile.ZipFile(path) as book:
        parts = {n: book.read(n) for n in book.namelist() if "sheet1" not in n}
    with zipfile.ZipFile(path, "w") as book:
        for name, data in parts.items():
            book.writestr(name, data)
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData>{"".join(lines)}</sheetData></worksheet>')


def test_sheets_of_different_columns_meet_by_name(spark, tmp_path):
    write_columns(tmp_path / "a.xlsx", ["ID", "Text"], [["1", "one"]])
    write_columns(tmp_path / "b.xlsx", ["Text", "More", "ID"], [["two", "m", "2"], ["three"]])
    xlsx.register(spark)
    df = spark.read.format("sheet").option("sheet", "One").load(str(tmp_path / "*.xlsx"))
    by_spark = xlsx.read_sheet(spark, f"file://{tmp_path}/*.xlsx", "One")
    assert sorted(map(str, by_spark.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="no sheet 'Two'"):
        xlsx.read_sheet(spark, f"file://{tmp_path}/*.xlsx", "Two").collect()
    assert df.columns == ["ID", "Text", "More"]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "one", None), ("2", "two", "m"), (None, "three", None)]
    with pytest.raises(Exception, match="schema lacks: More"):
        spark.read.format("sheet").schema("ID string, Text string").option("sheet", "One").load(str(tmp_path / "*.xlsx")).collect()


def test_id_lookup_reads_all_pages():
    asked = []

    def get(url):
        query = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(url).query).items()}
        dois = query["filter"].removeprefix("doi:").split("|")
        asked.append((len(dois), query["cursor"]))
        works = [{"id": f"W{i}-{d}", "doi": d} for d in dois for i in range(3)]
        start = 0 if query["cursor"] == "*" else int(query["cursor"])
        more = str(start + 60) if start + 60 < len(works) else None
        return {"results": works[start : start + 60], "meta": {"next_cursor": more}}

    dois = [f"10.1234/{i}" for i in range(49)] + ["10.1234/a,b"]
    found = paged.fetch_ids(dois, get)
    assert len(found) == 150 and len({w["id"] for w in found}) == 150
    assert asked == [(49, "*"), (49, "60"), (49, "120"), (1, "*")]


def test_vectors_of_another_width_raise(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, embedding array<double>")
    assert sorted(map(tuple, unpack_vectors(df, 2).collect())) == [(1, 1.0, 2.0), (2, None, None)]
    with pytest.raises(Exception, match="not 3 components but 2"):
        unpack_vectors(df, 3).collect()


def test_rebuild_of_nothing_keeps_the_schema(spark, tmp_path):
    df = spark.createDataFrame([], "a int, k string")
    for partitions in (None, ["k"]):
        path = rebuild(df, str(tmp_path / f"t{partitions is None}"), partitions)
        assert spark.read.parquet(path).count() == 0 and set(spark.read.parquet(path).columns) == {"a", "k"}


def test_marks_see_what_changes(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "a string, b string")
    tables = [rows(("x", None)), rows((None, "x")), rows(("x", "y"), ("x", "y")), rows(("z", "y"), ("z", "y")), rows(("x", "y"))]
    marks = [input_mark(t) for t in tables]
    assert len(set(marks)) == 5
    assert input_mark(rows(("1", "2"), ("3", "4"))) == input_mark(rows(("3", "4"), ("1", "2")).repartition(2))
    assert settings_mark(SheetMap("i", "a", "b")) != settings_mark(SheetMap("i", "a", "c"))


def items():
    base = {"itemType": "book", "title": "T", "date": "May 2001", "creators": [{"name": "Team"}, {"lastName": "B"}]}
    tags = [{"tag": "Chapter 1"}, {"tag": "chapter 2"}, {"tag": "x"}]
    return [{"data": {**base, "key": "A", "tags": tags}}, {"data": {"key": "B"}}, {"data": {**base, "key": "A", "tags": tags}}]


def test_library_source(spark, tmp_path):
    (tmp_path / "total").write_text("103")
    (tmp_path / "page-0.json").write_text(json.dumps(items()[:2]))
    (tmp_path / "page-100.json").write_text(json.dumps(items()[2:]))
    paged.register(spark)
    pages = spark.read.format("library").option("group", "5").option("path", str(tmp_path)).load()
    assert pages.rdd.getNumPartitions() == 2
    rows = one_per_chapter(item_rows(pages, "5"), ["page", "position"])
    got = {(r.key, r.chapter): (r.authors, r.first_author, r.year, r.tags) for r in rows.collect()}
    assert got == {
        ("A", "Chapter 1"): ("Team; B", "Team", "2001", "Chapter 1; chapter 2; x"),
        ("A", "chapter 2"): ("Team; B", "Team", "2001", "Chapter 1; chapter 2; x"),
        ("B", "No Chapter"): (None, None, None, None),
    }
    (tmp_path / "total").write_text("0")
    with pytest.raises(Exception, match="no items"):
        spark.read.format("library").option("path", str(tmp_path)).load().collect()


def test_id_lookup_asks_once_per_doi(spark):
    library = spark.createDataFrame([("1", "https://doi.org/10.1234/A"), ("2", "10.1234/a"), ("2", None)], "chapter string, doi string")
    fetch = lambda dois: [{"id": f"W-{d}", "doi": d} for d in dois]
    assert [tuple(r) for r in paged.lookup_ids(library, fetch, 2).collect()] == [("W-10.1234/a", "10.1234/a")]


def test_trees(spark, tmp_path):
    df = spark.createDataFrame([(1, "007"), (2, "a b")], "n int, k string")
    path = rebuild(df, str(tmp_path / "t"), ["k"])
    replace_partitions(spark.createDataFrame([(3, "a b")], "n int, k string"), path, ["k"])
    assert sorted(tuple(r) for r in read_tree(spark, path, ["n", "k"]).collect()) == [(1, "007"), (3, "a b")]
    assert read_tree(spark, path, flat=True).columns == ["n"]
    assert spark.read.parquet(rebuild(df.limit(0), str(tmp_path / "e"), ["k"])).columns == ["n", "k"]


def test_embedding_is_incremental(spark, tmp_path):
    docs = spark.createDataFrame([("1", "T", "one"), ("2", "T", None), ("3", "T", "three")], "id string, title string, abstract string")
    root, backend = str(tmp_path / "v"), HashBackend()
    run = lambda df: embed_works(df, root, "keypaper", "m", "title_abstract", backend)
    assert (run(docs), run(docs)) == (2, 0)
    assert run(docs.withColumn("abstract", F.when(F.col("id") == "1", "edited").otherwise(F.col("abstract")))) == 1
    assert spark.read.parquet(leaf_path(root, "m", "keypaper", "title_abstract")).count() == 3
    with pytest.raises(ValueError):
        leaf_path(root, "m", "other", "title")
    with pytest.raises(ValueError):
        variant_preprocessor("unknown")
    assert http_backend({"host": "h", "port": 80, "model": "x"}).request_size == 32


def test_stream_embeds_arrivals_once(spark, tmp_path):
    inbox, root, mark = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "id string, title string, abstract string"
    spark.createDataFrame([("1", "T", "one")], schema).write.parquet(inbox)
    go = lambda ck: embed_arrivals(spark, inbox, schema, root, ck, "corpus", "m", "title", HashBackend()).awaitTermination()
    go(mark)
    spark.createDataFrame([("2", "U", "two"), ("1", "T", "one")], schema).write.mode("append").parquet(inbox)
    go(mark)
    go(mark + "2")
    assert spark.read.parquet(leaf_path(root, "m", "corpus", "title")).count() == 2
    assert progress_line(50, 200, 10) == "50/200 (25.0%) 5.0 rows/s, 0h00m left"


def test_topics(spark):
    near = lambda i, n: i * n % 101 / 1000
    red, blue = lambda i: [1.0, near(i, 37), near(i, 53)], lambda i: [near(i, 41), 1.0, near(i, 59)]
    rows = [(str(i), red(i), "red apple") if i % 2 else (str(i), blue(i), "blue sky") for i in range(40)]
    corpus = spark.createDataFrame(rows, "id string, embedding array<double>, text string")
    keys = corpus.filter("id in ('1', '3')").withColumn("id", F.concat(F.lit("k"), "id"))
    late = spark.createDataFrame([("1", [1.0, 0.0, 0.0]), ("f", [1.0, 0.0, 0.1])], "id string, embedding array<double>")
    settings = TopicSettings(sample_size=20, min_topic_size=6, min_samples=2, components=2)
    topics = assign_all(corpus.drop("text"), keys.drop("text"), settings, late)
    assert {r.topic_source: r["count"] for r in topics.groupBy("topic_source").count().collect()} == {
        "embedding": 22, "transferred": 20, "transfer": 1,
    }
    docs = topics.join(corpus.select("id", "text"), "id")
    info = topic_info(topics, top_words(topic_terms(docs, [], (1, 2)), 2), 2).collect()
    assert sum(r.n_total for r in info) == 43 and sum(r.n_keypapers for r in info) == 2
    assert {r.is_relevant for r in info} == {True, False} and {len(r.top_words) for r in info} == {2}


CONFIG = """
embeddings: {active: m, configs: {m: {model: md5, sep_token: "", title_cap_combined: 200, host: h, port: 1}}}
sheets:
  approaches: {id: ID, title: Name, abstract_raw: Text, id_prefix: "P:"}
  actions: {id: ID, title: Name, abstract_raw: Text, category: Group}
citing: {default: lib, actions: other}
"""


def test_workflow(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(CONFIG)
    settings = load_settings(str(tmp_path / "c.yaml"))
    a = spark.createDataFrame([("1", "A", "As Kabeer (1999) and (Ng, 2001) say")], "ID string, Name string, Text string")
    b = spark.createDataFrame(
        [("x", "B", "See (Kabeer, 1999)", "g"), ("y", "C", "None cited", "g")], "ID string, Name string, Text string, Group string"
    )
    library = spark.createDataFrame(
        [(1, "lib", "K", "Kabeer", "Kabeer", "1999", None), (2, "other", "K", "Kabeer", "Kabeer", "1999", None), (3, "lib", "N", "Ng", "Ng", "2001", None)],
        "n int, assessment string, key string, first_author string, authors string, year string, doi string",
    )
    ids = spark.createDataFrame([], "id string, doi string")
    corpus = spark.createDataFrame([("zotero:K",), ("zotero:N",)], "id string")
    run = lambda: link_definitions(
        spark, str(tmp_path / "out"), settings, {"approaches": a, "actions": b}, library, ids, corpus, HashBackend(), ["n"]
    )
    pairs = {(r.id_a, r.id_b): r for r in run().collect()}
    assert len(pairs) == 6 and pairs["P:1", "x"].jaccard == 0.5 and pairs["x", "y"].jaccard == 0
    assert pairs["P:1", "x"].sim == pairs["x", "P:1"].sim
    before = sorted(os.listdir(tmp_path / "out" / "linked_pairs"))
    assert run().count() == 6 and sorted(os.listdir(tmp_path / "out" / "linked_pairs")) == before
    labels = run().withColumns({"label_a": F.col("id_a"), "label_b": F.col("id_b")})
    svg = pair_grid_svg(cell_style(labels))
    assert svg.count("<rect") >= 7 and "P:1" in svg
    matrix = spark.createDataFrame([("a", "b", 0.5)], "keyset_a string, keyset_b string, mean_value double")
    save_figure(matrix_svg(matrix, "means"), str(tmp_path / "fig"), "m")
    assert "m.svg" in download_line(str(tmp_path / "fig"), "m")
    assert "0.500" in report_page("r", [("c", matrix_svg(matrix, "means"))]) and "&lt;" in index_page("i", [("f", "<n>", "t")])


def test_topics_are_fitted_on_all_rows(spark):
    from weftlink.registry.topics import topic_assignment

    sf = "/root/testdata/sf0.001"
    got = topic_assignment(spark, sf)
    assert {r.topic_source for r in got.select("topic_source").distinct().collect()} == {"embedding"}
    assert got.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_terms_are_counted_in_tasks(spark, monkeypatch):
    """Counts of a word come from many rows, tasks and pieces; only buckets of them are shuffled, and nothing counted is joined."""
    from weftlink.operators import topics

    texts = [(i % 3, f"w{i % 7} x{i % 5} w{i % 7} Ünal") for i in range(40)] + [(None, "w1 x1"), (1, None), (2, ""), (0, "a lone")]
    docs = spark.createDataFrame(texts, "topic_id long, text string").repartition(3)
    grams = collections.Counter()
    for topic, text in texts:
        words = [w for w in (text or "").lower().split() if len(w) > 1 and w != "w0"]
        grams.update((topic, " ".join(words[i : i + n])) for n in (1, 2) for i in range(len(words) - n + 1))
    df, f = collections.Counter(w for _, w in grams), collections.Counter()
    for (_, word), n in grams.items():
        f[word] += n
    kept = {k: n for k, n in grams.items() if 2 <= df[k[1]] <= 0.9 * 3}
    size = collections.Counter()
    for (topic, _), n in kept.items():
        size[topic] += n
    mean = sum(size.values()) / len(size)
    want = {(t, w): (n, round(n / size[t] * math.log(1 + mean / f[w]), 9)) for (t, w), n in kept.items() if t is not None}
    for held in (4_000_000, 5):  # 5: texts are cut within runs, counts come in many pieces
        monkeypatch.setattr(topics, "RUNS_HELD", held)
        got = topic_terms(docs, ["w0"], (1, 2), 2, 0.9)
        assert {(r.topic_id, r.word): (r.n, round(r.weight, 9)) for r in got.collect()} == want
    words = pa.array(["x", "ab", "", "x", "ab", "é"])
    assert [*topics.buckets_of(words.slice(1))] == [*topics.buckets_of(words)][1:]
    counted = topics.run_counter((1, 2))(iter([pa.record_batch({"topic_id": [1, 2], "words": [["a", "b", "a"], ["c"]]})]))
    rows = [r for b in counted for x in b.to_pylist() for r in zip(x["topic_id"], x["word"], x["n"], strict=True)]
    assert sorted(rows) == [(1, "a", 2), (1, "a b", 1), (1, "b", 1), (1, "b a", 1), (2, "c", 1)]


def test_texts_are_cleaned_once(spark):
    rows = [("1", "T <b>x</b>", "Abstract: $a$ &amp; \\emph{b}"), ("2", "T", " "), ("3", None, "one")]
    texts = title_abstract_text(spark.createDataFrame(rows, "id string, title string, abstract string"))
    assert [tuple(r)[:4] for r in texts.collect()] == [("1", "T x", "a & b", "T x [SEP] a & b")]
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("abstract|summary") == 1 and plan.count("html_to_text") == 2
