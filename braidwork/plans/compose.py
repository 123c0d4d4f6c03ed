"""Pipelines: named steps over named relations, composed in order or as a graph."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame


class GraphError(ValueError):
    """A step asks for what isn't there, or steps wait for one another."""


class Graph:
    """Steps by the name of what they make. A step's parameters name the inputs and steps that it reads.

    A step returns a relation, or a dict of relations that are known as step.name. Everything stays lazy: what no
    output needs isn't planned by Spark.
    """

    def __init__(self, **steps: Callable[..., DataFrame | dict[str, DataFrame]]) -> None:
        self.steps = steps

    def order(self, inputs: Mapping[str, DataFrame]) -> list[str]:
        """The steps, each behind those that it reads."""
        done, order, left = set(inputs), [], dict(self.steps)
        while left:
            ready = [n for n, f in left.items() if all(p in done for p in inspect.signature(f).parameters)]
            if not ready:
                missing = sorted({p for f in left.values() for p in inspect.signature(f).parameters} - done - set(left))
                raise GraphError(f"no {', '.join(missing)}" if missing else f"a cycle among {', '.join(sorted(left))}")
            for n in ready:
                order.append(n)
                done.add(n)
                left.pop(n)
        return order

    def run(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        """All relations that the steps make."""
        known: dict = dict(inputs)
        for name in self.order(inputs):
            step = self.steps[name]
            made = step(**{p: known[p] for p in inspect.signature(step).parameters})
            known[name] = made
            if isinstance(made, dict):
                known |= {f"{name}.{k}": v for k, v in made.items()}
        return {n: df for n, df in known.items() if n not in inputs and isinstance(df, DataFrame)}

    def extend(self, **steps) -> Graph:
        """These steps and others; one of the same name takes the place of the old."""
        return Graph(**(self.steps | steps))


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One step after the other."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def plan_text(df: DataFrame) -> str:
    """The physical plan as explain("formatted") has it."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
