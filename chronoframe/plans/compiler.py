"""Syntax tree to a lazy DataFrame (name, labels, series_key, ts, value, seq).

Result labels hold the metric's name under __name__. The start of the whole
expression moves back by its longest range, and a range selector moves back by
its own range once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.errors import QueryError
from chronoframe.model import NAME, SAMPLES
from chronoframe.operators import aggregates, arithmetic
from chronoframe.plans.nodes import Aggregate, Binary, Call, Number, Selector, longest_range
from chronoframe.plans.parser import parse


def effective_range(root, node: Selector, start: int, end: int) -> tuple[int, int]:
    return start - longest_range(root) - (node.range_ms or 0), end


class Compiler:
    def __init__(self, source, start: int, end: int, match: str = "first"):
        if match not in ("first", "labels"):
            raise QueryError(f"unknown matching {match!r}")
        self.source, self.start, self.end, self.match = source, start, end, match

    def run(self, text: str) -> DataFrame:
        self.root = parse(text)
        return self.build(self.root)[0]

    def build(self, node) -> tuple[DataFrame, bool]:
        """The plan, and whether its series have one sample at most at each timestamp."""
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def _number(self, node: Number):
        spark = self.source.spark
        row = spark.range(1).select(F.lit("").alias("name"), F.expr("map()").cast("map<string,string>").alias("labels"), F.lit("").alias("series_key"), F.lit(self.end).cast("long").alias("ts"), F.lit(node.value).cast("double").alias("value"), F.lit(0).cast("long").alias("seq"))
        return row, True

    def _selector(self, node: Selector):
        start, end = effective_range(self.root, node, self.start, self.end)
        rows = self.source.scan(node.name, start, end, node.matchers)
        return rows.withColumn("labels", F.map_concat(F.map_filter("labels", lambda k, _: k != NAME), F.create_map(F.lit(NAME), F.col("name")))), False

    def _call(self, node: Call):
        inner, _ = self.build(node.args[-1])
        return (aggregates.rate(inner) if node.function == "rate" else aggregates.quantile(inner, node.args[0].value)), True

    def _aggregate(self, node: Aggregate):
        inner, unique = self.build(node.inner)
        if node.k is not None:
            if node.without is not None:
                raise QueryError(f"{node.op} takes by, not without")
            return aggregates.ranked(inner, node.op, node.k, node.by or (), unique), True
        if node.without is not None:
            return aggregates.aggregate_without(inner, node.op, node.without, unique), True
        return aggregates.aggregate(inner, node.op, node.by or (), unique), True

    def _binary(self, node: Binary):
        folded = fold(node)
        if isinstance(folded, Number):
            return self._number(folded)
        left, unique = self.build(node.left)
        right = fold(node.right)
        if isinstance(right, Number):
            return arithmetic.with_literal(left, node.op, right.value), unique
        right, right_unique = self.build(right)
        if self.match == "labels" and not isinstance(fold(node.left), Number):
            return arithmetic.matched(left, node.op, right), unique and right_unique
        return arithmetic.combine(left, node.op, right), unique and right_unique


def fold(node):
    """Numbers combined while compiling; anything else as it is."""
    if not isinstance(node, Binary):
        return node
    a, b = fold(node.left), fold(node.right)
    if not (isinstance(a, Number) and isinstance(b, Number)):
        return node
    x, y = a.value, b.value
    return Number({"+": x + y, "-": x - y, "*": x * y, "/": x / y if y else 0.0}[node.op])


COLUMNS = [c.split()[0] for c in SAMPLES.split(", ")]
