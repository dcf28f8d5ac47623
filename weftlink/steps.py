"""Stored tables that depend on each other: what is out of date is made again, part by part.

A step has one table under the store's root. Its mark says what it was made from: its settings and the marks of its
inputs, down to the content of the sources. A step with ``by`` has one mark for each value of that column, so an
edited part of a source makes only that part of the tables after it anew. Marks follow from the sources alone, so
what is out of date is known before anything is made.
"""

from __future__ import annotations

import argparse
import hashlib
import importlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.session import cut_lineage
from weftlink.sources.parquet import NO_VALUE, content_mark, drop_partitions, read_tree, rebuild, replace_partitions

#: The part of a table that is not made by parts.
WHOLE = ""
Table = DataFrame | dict[str, DataFrame]
Marks = dict[str, str]


@dataclass(frozen=True)
class Step:
    """``build`` gets its inputs by name: stored tables, and sources as they were given (of the parts to be made)."""

    name: str
    inputs: list[str]
    build: Callable[[dict[str, Table]], DataFrame]
    settings: object = None
    by: str | None = None


def _digest(*values: object) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=lambda v: getattr(v, "__dict__", str(v))).encode()).hexdigest()



@dataclass
class StepGraph:
    """Steps over one root. A source is a table, or tables by part; ``by`` columns of plain tables give parts too."""

    spark: SparkSession
    root: str
    steps: list[Step]
    sources: dict[str, Table] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.by_name = {s.name: s for s in self.steps}
        if len(self.by_name) < len(self.steps) or set(self.by_name) & set(self.sources):
            raise ValueError("two steps or sources of one name")
        self.order = self._sorted()
        self._source_marks: dict[tuple[str, str | None], Marks] = {}

    def _sorted(self) -> list[str]:
        order: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str, way: tuple[str, ...]) -> None:
            if name in self.sources or state.get(name) == 2:
                return
            if name not in self.by_name:
                raise ValueError(f"{way[-1]} needs {name}, which is no step and no source")
            if state.get(name) == 1:
                raise ValueError("steps in a circle: " + " - ".join([*way[way.index(name) :], name]))
            state[name] = 1
            for other in self.by_name[name].inputs:
                visit(other, (*way, name))
            state[name] = 2
            order.append(name)

        for step in self.steps:
            visit(step.name, ())
        return order

    # ---- marks --------------------------------------------------------------------------------
    def _marks_of_source(self, name: str, by: str | None) -> Marks:
        """The content of a source, by part where it has parts; worked out once for each way it is asked for."""
        source = self.sources[name]
        by = by if isinstance(source, dict) or by in source.columns else None
        if (name, by) not in self._source_marks:
            if isinstance(source, dict):
                marks = {part: _digest(sorted(t.columns), *map(str, content_mark(t))) for part, t in source.items()}
                marks = marks if by else {WHOLE: _digest(sorted(marks.items()))}
            elif by:
                values = [F.col(f"`{c}`") for c in sorted(source.columns)]
                hashes = [F.xxhash64(F.lit(s), *values, *[v.isNull() for v in values]).cast("decimal(38,0)") for s in (1, 2)]
                rows = source.groupBy(F.col(by).cast("string").alias("part")).agg(F.count("*"), *map(F.sum, hashes)).collect()
                # one row for each part
                marks = {_part(r.part): _digest(sorted(source.columns), *map(str, r[1:])) for r in rows}
            else:
                marks = {WHOLE: _digest(sorted(source.columns), *map(str, content_mark(source)))}
            self._source_marks[name, by] = marks
        return self._source_marks[name, by]

    def marks(self) -> dict[str, Marks]:
        """What each step's table has to be made from."""
        out: dict[str, Marks] = {}
        for name in self.order:
            step = self.by_name[name]
            of_inputs = {}
            for other in step.inputs:
                marks = self._marks_of_source(other, step.by) if other in self.sources else out[other]
                of_inputs[other] = marks
            parted = {
                k: m for k, m in of_inputs.items() if step.by and (set(m) - {WHOLE} or self._parted(k, step.by))
            }
            whole = {k: _digest(sorted(m.items())) for k, m in of_inputs.items() if k not in parted}
            parts = sorted({p for m in parted.values() for p in m}) if parted else [WHOLE]
            out[name] = {p: _digest(step.settings, sorted(whole.items()), [(k, m.get(p)) for k, m in sorted(parted.items())]) for p in parts}
        return out

    def _parted(self, name: str, by: str) -> bool:
        if name in self.by_name:
            return self.by_name[name].by == by
        source = self.sources[name]
        return isinstance(source, dict) or by in source.columns

    def _mark_path(self, name: str) -> str:
        return f"{self.root}/_made_from/{name}"

    def stored_marks(self, name: str) -> Marks:
        try:
            rows = self.spark.read.schema("part string, mark string").json(self._mark_path(name)).collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise
        return {r.part: r.mark for r in rows}

    def _store_marks(self, name: str, marks: Marks) -> None:
        rows = self.spark.createDataFrame(list(marks.items()), "part string, mark string")
        rows.coalesce(1).write.mode("overwrite").json(self._mark_path(name))

    # ---- commands -----------------------------------------------------------------------------
    def read(self, name: str) -> DataFrame:
        return read_tree(self.spark, f"{self.root}/{name}")

    def outdated(self) -> dict[str, list[str]]:
        """Steps in the order they would be made, with the parts that are not as they have to be (gone ones too)."""
        out = {}
        for name, wanted in self.marks().items():
            stored = self.stored_marks(name)
            parts = sorted(p for p in set(wanted) | set(stored) if wanted.get(p) != stored.get(p))
            if parts:
                out[name] = parts
        return out

    def run(self, names: Iterable[str] | None = None) -> dict[str, list[str]]:
        """Make what is out of date, or of it what the named steps need; returns the parts made of each step.

        A step's marks are stored after its table, so a step that fails half-way is out of date still.
        """
        needed = set(self.order) if names is None else self._upstream(names)
        wanted, made = self.marks(), {}
        for name in self.order:
            if name not in needed:
                continue
            step, stored = self.by_name[name], self.stored_marks(name)
            fresh = sorted(p for p, m in wanted[name].items() if stored.get(p) != m)
            gone = sorted(set(stored) - set(wanted[name]))
            if fresh or gone:
                self._make(step, fresh, gone, known=bool(stored))
                self._store_marks(name, wanted[name])
                made[name] = fresh
        return made

    def _make(self, step: Step, fresh: list[str], gone: list[str], known: bool) -> None:
        path = f"{self.root}/{step.name}"
        if step.by is None or not known or WHOLE in [*fresh, *gone]:
            parts = None if step.by is None or WHOLE in fresh else fresh
            rebuild(step.build({k: self._input(k, step.by, parts) for k in step.inputs}), path, [step.by] if step.by else None)
            return
        if fresh:
            rows = cut_lineage(step.build({k: self._input(k, step.by, fresh) for k in step.inputs}))
            replace_partitions(rows, path, [step.by])
            # a part may have no rows left
            wanted = self.spark.createDataFrame([(p,) for p in fresh], f"{step.by} string")
            held = rows.select(F.coalesce(F.col(step.by).cast("string"), F.lit(NO_VALUE)).alias(step.by)).distinct()
            drop_partitions(wanted.join(held, step.by, "left_anti"), path, [step.by])
        if gone:
            drop_partitions(self.spark.createDataFrame([(p,) for p in gone], f"{step.by} string"), path, [step.by])

    def _input(self, name: str, by: str | None, parts: list[str] | None) -> Table:
        table = self.sources.get(name)
        if isinstance(table, dict):
            return table if parts is None else {p: t for p, t in table.items() if p in parts}
        table = self.read(name) if table is None else table
        if parts is None or not self._parted(name, by):
            return table
        chosen = self.spark.createDataFrame([(p,) for p in parts], "_part string")
        return table.join(chosen, F.coalesce(F.col(by).cast("string"), F.lit(NO_VALUE)) == F.col("_part"), "left_semi")

    def _upstream(self, names: Iterable[str]) -> set[str]:
        found, todo = set(), list(names)
        while todo:
            name = todo.pop()
            if name in self.sources or name in found:
                continue
            if name not in self.by_name:
                raise ValueError(f"{name} is no step")
            found.add(name)
            todo += self.by_name[name].inputs
        return found

    def invalidate(self, names: Iterable[str]) -> None:
        """Have steps made again on the next run; their tables stay until then."""
        for name in names:
            self._upstream([name])
            self._store_marks(name, {})

    def clean(self, names: Iterable[str] | None = None) -> None:
        """Remove steps' tables and marks (all of them unless named)."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in self.order if names is None else names:
            self._upstream([name])
            for path in (self._mark_path(name), f"{self.root}/{name}"):
                at = hadoop.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
                self.spark.catalog.refreshByPath(path)


def _part(value: str | None) -> str:
    return NO_VALUE if value is None else value


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """``python -m weftlink.steps module:function run|outdated|invalidate|clean [step ...]``; the function makes the graph of a session."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("graph")
    parser.add_argument("command", choices=["run", "outdated", "invalidate", "clean"])
    parser.add_argument("steps", nargs="*")
    given = parser.parse_args(arguments)
    if given.command == "invalidate" and not given.steps:
        parser.error("name the steps to invalidate")
    module, function = given.graph.split(":")
    if spark is None:
        from weftlink.session import build_session

        spark = build_session()
    graph = getattr(importlib.import_module(module), function)(spark)
    if given.command == "outdated":
        found = graph.outdated()
        shown = {k: v for k, v in found.items() if not given.steps or k in given.steps}
    elif given.command == "run":
        shown = graph.run(given.steps or None)
    else:
        getattr(graph, given.command)(given.steps or None)
        shown = {}
    for name, parts in shown.items():
        print(name, *[p for p in parts if p != WHOLE])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
