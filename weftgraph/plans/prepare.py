"""From a graph to its partitioned form: assignment, classes, exchange plan, report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.common import cut
from weftgraph.graph import Graph
from weftgraph.operators import classify
from weftgraph.operators.partitioning import partition
from weftgraph.sources.sinks import materialise


@dataclass
class Prepared:
    graph: Graph
    parts: DataFrame
    book: DataFrame
    classes: DataFrame
    exclusive: DataFrame
    exchange: DataFrame
    report: DataFrame


def prepare(graph: Graph, k: int, method: str = "chunk", symmetric: bool = True, self_loops: bool = False, export: str | None = None, **options) -> Prepared:
    """One lazy plan but for the assignment, which is cut; with ``export`` the parts are also written there."""
    graph = graph.symmetrised() if symmetric else graph
    graph = graph.with_self_loops() if self_loops else graph
    parts = cut(partition(graph, k, method, **options))
    crossing = classify.boundary(graph.edges, parts)
    if export:
        materialise(graph, parts, export)
    return Prepared(graph, parts, classify.part_book(parts), classify.node_classes(graph.edges, parts), classify.exclusive_dependencies(crossing), classify.exchange(crossing), classify.report(graph.edges, parts))


def grid(**choices: list) -> list[dict]:
    """All combinations of the given choices, for a series of runs."""
    runs: list[dict] = [{}]
    for name, values in choices.items():
        runs = [r | {name: v} for r in runs for v in values]
    return runs


def run_grid(graph: Graph, k: int, series: list[dict]) -> DataFrame:
    """(run, part_id, n_all, ...): the report of each run of a series, whose entries are options of ``prepare``."""
    reports = [prepare(graph, k, **options).report.withColumn("run", F.lit(i)) for i, options in enumerate(series)]
    return reduce(DataFrame.unionByName, reports)
