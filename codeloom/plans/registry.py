"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from codeloom.graph import Graph, with_graph

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Workspace:
    """The tables of one folder; each is opened when a query first asks for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def graph(self) -> Graph:
        return Graph.load(self.spark, self.folder)


def query(sql: str | None = None, graph: bool = True, recursive: bool = False):
    """Register a function of a :class:`Workspace` under its own name, with its SQL over the graph's views or the tables."""

    def add(rule: Callable[[Workspace], DataFrame]):
        QUERIES[rule.__name__] = lambda spark, folder: rule(Workspace(spark, folder))
        if sql is not None:
            ORACLE[rule.__name__] = with_graph(sql, recursive) if graph else sql
        return rule

    return add
