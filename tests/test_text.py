import pytest
from pyspark.sql import functions as F

from weftlink.functions import text as T
from weftlink.functions.citations import find_citations, strip_citations
from weftlink.functions.html import clean_abstract, clean_title
from weftlink.functions.names import author_key, surname_key
from weftlink.operators.definitions import SheetMap, definition_meta, prepare_definitions

CITATIONS = {
    "(Kabeer, 1999)": [("kabeer", 1999)],
    "(Kabeer, 1999; Manlosa, 2022)": [("kabeer", 1999), ("manlosa", 2022)],
    "(K. Brown & Westaway, 2011)": [("brown", 2011)],
    "(Tscharntke et al., 2005)": [("tscharntke", 2005)],
    "Olsson et al (2004)": [("olsson", 2004)],
    "van Delden (2021a)": [("vandelden", 2021)],
    "(e.g. Kawaka et al., 2017)": [("kawaka", 2017)],
    "(Kabeer, 1999, 2001)": [("kabeer", 1999), ("kabeer", 2001)],
    "(Kabeer, 1999; 2001)": [("kabeer", 1999)],
    "García (2020)": [],
    "Smith, Jones and Brown (2010)": [("jones", 2010)],
    "(following the work of Ostrom, 1990)": [("the", 1990)],
    "K. Brown & Westaway (2011) and (Ng, 2001), again (Ng, 2001)": [("brown", 2011), ("ng", 2001)],
    "(first line\nOlsson, 2004\nmore)": [("firstlineolsson", 2004)],
    "": [],
}
SURNAMES = {
    "K. Brown & Westaway": "brown",
    "J.R. R. Tolkien": "tolkien",
    "K. R.": "r",
    "van der Berg": "vanderberg",
    "van der": "vanderna",
    "also: Babí Almenar et al.": "babi",
    "cf. also Müller-Lüdenscheidt": "mullerludenscheidt",
    "Ieñó": "no",
    "Straße": "strasse",
    "": None,
    None: None,
}


def one(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_find_citations(spark):
    found = one(spark, CITATIONS, find_citations)
    for text, got in zip(CITATIONS, found):
        assert [(c.author_key, c.year) for c in got] == CITATIONS[text] or "\n" in text, text


def test_surname_key(spark):
    assert dict(zip(SURNAMES, one(spark, SURNAMES, surname_key))) == SURNAMES


def test_author_key(spark):
    assert one(spark, ["Łódź", "Ångström", "O'Neill", None], author_key) == ["lodz", "angstrom", "oneill", ""]
    letters = {"Nguyễn": "nguyen", "Phạm": "pham", "Þórðarson": "thordarson", "Guðmundsdóttir": "gudmundsdottir", "Trần": "tran", "Ẵng": "ang"}
    assert one(spark, list(letters), author_key) == list(letters.values())


def test_strip_citations(spark):
    given = ["A gap (Kabeer, 1999) , then Olsson et al (2004).", "keep (this) (;) \t  one", None]
    assert one(spark, given, strip_citations) == ["A gap, then Olsson et al.", "keep (this) one", None]


def test_clean_text(spark):
    given = [
        "<p>Abstract: A &amp; <i>B</i></p>",
        r"Summary of $x^2$ and \emph{this} \alpha",
        "<br/> ",
        None,
        "<script>var t=\"</p>\";</script>x",
    ]
    assert one(spark, given, clean_abstract) == ["A & B", "of x^2 and this", None, None, 'var t="</p>";x']
    assert one(spark, given[:1], clean_title) == ["Abstract: A & B"]


def test_tokens_and_words(spark):
    assert one(spark, ["abcde", "", None], T.estimate_tokens) == [2, 0, 0]
    assert one(spark, [" a  b\tc ", "", None], T.count_words) == [3, 0, 0]
    assert one(spark, ["1999-05", "n.d.", None], T.year_int) == [1999, None, None]
    assert one(spark, ["Spring 1999/2000", "n.d.", ""], T.year_from_date) == ["1999", None, None]
    assert one(spark, [" HTTPS://doi.org/10.1/A ", "doi:10.1/b", None], T.norm_doi) == ["10.1/a", "10.1/b", ""]


def test_prepare_definitions(spark):
    a = spark.createDataFrame(
        [("1", " Power ", "To act (Kabeer, 1999).\t"), (None, "x", "y"), ("2", "z", " ")], "ID string, Name string, Text string"
    )
    b = spark.createDataFrame([("1.1", "Land", "d" * 4000, "S", "Short")], "ID string, Action string, Def string, Group string, Short string")
    sheets = {
        "first": (a, SheetMap(id="ID", title="Name", abstract_raw="Text", id_prefix="P:")),
        "second": (b, SheetMap(id="ID", title="Action", abstract_raw="Def", category="Group", short_name="Short", code="Gone")),
    }
    rows = {r.id: r for r in prepare_definitions(sheets).collect()}
    assert set(rows) == {"P:1", "1.1"}
    assert rows["P:1"].abstract == "To act." and rows["P:1"].title == "Power" and rows["P:1"].category is None
    # 1 + 1 + 1 words, ceil(4011 / 4) tokens: 3 - floor(3 * 512 / 1003) words too many
    assert rows["1.1"].shorten_title_abstract_by_words == 2
    assert definition_meta(prepare_definitions(sheets)).count() == 2
    with pytest.raises(ValueError, match="non-unique"):
        prepare_definitions({"one": sheets["first"], "two": sheets["first"]})


def test_config_folder():
    from weftlink.operators.checks import config_of

    assert config_of("/v/config=a/source=corpus", "/v/config=a/source=keypaper/") == "a"
    for leaves in (("/v/config=a/source=corpus", "/v/config=b/source=keypaper"), ("/v/x/source=corpus",)):
        with pytest.raises(ValueError, match="one config folder"):
            config_of(*leaves)


def test_backend_takes_what_the_server_says(monkeypatch):
    import io
    import json

    from weftlink.operators import embedding

    asked, said = [], {"model_id": "served/model", "max_client_batch_size": 8}
    monkeypatch.setattr(embedding.urllib.request, "urlopen", lambda r, timeout: (asked.append(r.full_url), io.BytesIO(json.dumps(said).encode()))[1])
    backend = embedding.http_backend({"host": "h", "port": 80, "model": "configured", "max_batch_size": 64})
    served = backend.as_served()
    assert (served.model, served.request_size, asked) == ("served/model", 8, ["http://h:80/info"])
    said.clear()
    assert backend.as_served() == backend
