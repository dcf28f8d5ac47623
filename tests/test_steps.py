"""The step graph: what is out of date, made part by part, forgotten and removed."""

import pytest
from pyspark.sql import functions as F

from weftlink import steps
from weftlink.steps import Step, StepGraph

MADE: list = []


def graph_of(spark, root, rows, names, factor=1):
    """doubled (by k), named (by k of both its inputs) and total (whole)."""

    def doubled(inputs):
        MADE.append(("doubled", sorted(str(r.k) for r in inputs["numbers"].select("k").distinct().collect())))
        return inputs["numbers"].withColumn("x", F.col("x") * 2 * factor)

    def named(inputs):
        MADE.append(("named", sorted(str(r.k) for r in inputs["doubled"].select("k").distinct().collect())))
        return inputs["doubled"].join(inputs["names"], "k")

    def total(inputs):
        MADE.append(("total", None))
        return inputs["doubled"].agg(F.sum("x").alias("x"))

    numbers = spark.createDataFrame(rows, "k string, x long")
    made = [
        Step("total", ["doubled"], total),
        Step("named", ["doubled", "names"], named, by="k"),
        Step("doubled", ["numbers"], doubled, settings=factor, by="k"),
    ]
    return StepGraph(spark, root, made, {"numbers": numbers, "names": spark.createDataFrame(names, "k string, name string")})


def held(graph, name):
    return sorted(tuple(str(v) for v in (r[c] for c in sorted(r.asDict()))) for r in graph.read(name).collect())


def test_an_edited_part_makes_one_branch(spark, tmp_path):
    root, names = str(tmp_path / "t"), [("a", "A"), ("b/=", "B"), ("c", "C")]
    rows = [("a", 1), ("b/=", 2), ("c", 3)]
    graph = graph_of(spark, root, rows, names)
    assert graph.order == ["doubled", "total", "named"]
    assert graph.outdated() == {"doubled": ["a", "b/=", "c"], "total": [""], "named": ["a", "b/=", "c"]}
    MADE.clear()
    assert list(graph.run()) == graph.order and graph.outdated() == {} and graph.run() == {}
    assert held(graph, "named") == [("a", "A", "2"), ("b/=", "B", "4"), ("c", "C", "6")] and held(graph, "total") == [("12",)]
    # one part edited, one gone, one new
    graph = graph_of(spark, root, [("a", 1), ("b/=", 5), ("d", 7)], [*names, ("d", "D")])
    assert graph.outdated()["doubled"] == ["b/=", "c", "d"]
    MADE.clear()
    assert graph.run(["doubled"]) == {"doubled": ["b/=", "d"]} and MADE == [("doubled", ["b/=", "d"])]
    assert held(graph, "doubled") == [("a", "2"), ("b/=", "10"), ("d", "14")]
    assert graph.outdated() == {"total": [""], "named": ["b/=", "c", "d"]}  # c still has a name, but no number
    assert graph.run() == {"total": [""], "named": ["b/=", "c", "d"]} and graph.outdated() == {}
    assert held(graph, "named") == [("a", "A", "2"), ("b/=", "B", "10"), ("d", "D", "14")] and held(graph, "total") == [("26",)]
    # only what follows from the edited part
    graph = graph_of(spark, root, [("a", 1), ("b/=", 6), ("d", 7)], [*names, ("d", "D")])
    MADE.clear()
    assert graph.run() == {"doubled": ["b/="], "total": [""], "named": ["b/="]}
    assert MADE == [("doubled", ["b/="]), ("total", None), ("named", ["b/="])]
    # settings make everything after them anew
    assert graph_of(spark, root, [("a", 1), ("b/=", 6), ("d", 7)], [*names, ("d", "D")], factor=2).outdated().keys() == {"doubled", "total", "named"}


def test_commands(spark, tmp_path, capsys, monkeypatch):
    root = str(tmp_path / "t")
    make = lambda s: graph_of(s, root, [("a", 1), (None, 2)], [("a", "A")])
    monkeypatch.setattr(steps, "graph_for_tests", make, raising=False)
    command = lambda *words: (steps.main(["weftlink.steps:graph_for_tests", *words], spark), capsys.readouterr().out)[1]
    assert command("outdated") == f"doubled {steps.NO_VALUE} a\ntotal\nnamed {steps.NO_VALUE} a\n"
    assert command("run", "total").split("\n")[:2] == [f"doubled {steps.NO_VALUE} a", "total"]
    assert command("outdated") == f"named {steps.NO_VALUE} a\n" and held(make(spark), "total") == [("6",)]
    command("run")
    assert command("outdated") == ""
    command("invalidate", "total")
    assert command("outdated") == "total\n" and held(make(spark), "total") == [("6",)]
    command("clean", "named")
    assert command("outdated") == f"total\nnamed {steps.NO_VALUE} a\n"
    command("run")
    # the rows without a value leave, and so does their folder
    graph = graph_of(spark, root, [("a", 1)], [("a", "A")])
    assert graph.run()["doubled"] == [] and held(graph, "doubled") == [("a", "2")]
    command("clean")
    assert command("outdated").count("\n") == 3
    with pytest.raises(SystemExit):
        command("invalidate")
    with pytest.raises(ValueError, match="no step"):
        make(spark).run(["nothing"])


def test_sources_by_part_and_bad_graphs(spark, tmp_path):
    one = lambda *r: spark.createDataFrame(list(r), "x long")
    build = lambda i: next(iter(i["sheets"].values())).withColumn("k", F.lit(next(iter(i["sheets"])))) if len(i["sheets"]) == 1 else (
        i["sheets"]["a"].withColumn("k", F.lit("a")).unionByName(i["sheets"]["b"].withColumn("k", F.lit("b"))))
    graph = lambda a, b: StepGraph(spark, str(tmp_path / "s"), [Step("all", ["sheets"], build, by="k")], {"sheets": {"a": one(*a), "b": one(*b)}})
    assert graph([(1,)], [(2,)]).run() == {"all": ["a", "b"]}
    assert graph([(1,)], [(3,)]).run() == {"all": ["b"]} and held(graph([(1,)], [(3,)]), "all") == [("a", "1"), ("b", "3")]
    step = lambda name, *inputs: Step(name, list(inputs), build)
    with pytest.raises(ValueError, match="circle: a - b - a"):
        StepGraph(spark, "r", [step("a", "b"), step("b", "a")])
    with pytest.raises(ValueError, match="a needs x"):
        StepGraph(spark, "r", [step("a", "x")])
    with pytest.raises(ValueError, match="one name"):
        StepGraph(spark, "r", [step("a"), step("a")])


def test_partitions_store_texts_once(spark, tmp_path, monkeypatch):
    """Repeats, new and lost rows are told by keys: texts are stored once a run and shuffled only where some of them are new."""
    from weftlink.operators import embedding as E

    rows = [(f"i{k}", f"T {k}", f"text {k} " * 3, "ab"[k % 2]) for k in range(20)]
    schema = "id string, title string, abstract string, part string"
    stored, cut = [], E.cut_lineage
    monkeypatch.setattr(E, "cut_lineage", lambda df: stored.append(df) or cut(df))

    def run(rows):
        stored.clear()
        return E.embed_partitions(spark.createDataFrame(rows, schema), "part", str(tmp_path), "corpus", "test", "title_abstract", E.HashBackend())

    leaf = E.leaf_path(str(tmp_path), "test", "corpus", "title_abstract")
    assert run(rows + rows[:5]) == 20  # repeats count once
    assert sum("text" in df.columns for df in stored) == 1
    assert "Exchange" not in next(df for df in stored if "text" in df.columns)._jdf.queryExecution().executedPlan().toString()
    assert run(rows) == 0
    assert run([*rows, ("i20", "T", "new", "b"), ("i1", "T 1", "edited", "b")]) == 2
    half = cut(spark.read.parquet(leaf).filter("part = 'a' and xxhash64(id) % 2 = 0"))
    assert 0 < half.count() < 10
    half.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(leaf)
    assert run(rows) == 10  # all of the damaged partition
    assert spark.read.parquet(leaf).select("id", "part").distinct().count() == 21
