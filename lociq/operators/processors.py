"""Named steps over a collection, in order, with what each took and left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Pipeline:
    """Filters, transforms, enrichments and free steps, run as one plan.

    Rows are counted between steps by observations, so an action on the result gives all counts in its one pass;
    tasks' counts are merged by Spark.
    """

    def __init__(self) -> None:
        self.steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self._seen: list[Observation] = []

    def step(self, name: str, function: Callable[[DataFrame], DataFrame]) -> Pipeline:
        self.steps.append((name, function))
        return self

    def filter(self, name: str, predicate: Column) -> Pipeline:
        return self.step(name, lambda df: df.where(predicate))

    def transform(self, name: str, column: str, value: Column) -> Pipeline:
        return self.step(name, lambda df: df.withColumn(column, value))

    def enrich(self, name: str, function: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """``function`` adds columns, as by a left join with a mapping."""
        return self.step(name, function)

    def run(self, rows: DataFrame) -> DataFrame:
        self._seen = [Observation() for _ in range(len(self.steps) + 1)]
        out = rows.observe(self._seen[0], F.count(F.lit(1)).alias("n"))
        for (_, function), seen in zip(self.steps, self._seen[1:]):
            out = function(out).observe(seen, F.count(F.lit(1)).alias("n"))
        return out

    def counts(self) -> list[tuple[str, int, int]]:
        """(step, rows in, rows out) of the last run, once an action has run."""
        n = [seen.get["n"] for seen in self._seen]
        return [(name, n[k], n[k + 1]) for k, (name, _) in enumerate(self.steps)]
