"""User functions: row and batch rewards, estimators, losses, dataset transforms, reduce functions."""

from __future__ import annotations

import functools
import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.advantages import register_estimator
from .operators.grouping import unit_digest
from .operators.losses import register_loss
from .sources.io import append_once, committed

REWARDS: dict[str, Callable] = {}


def load_function(path: str, name: str) -> Callable:
    """A function by file path and name; a missing file or name is an error."""
    spec = importlib.util.spec_from_file_location("user_functions", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    return getattr(module, name)


def register_reward(name: str, fn: Callable) -> None:
    REWARDS[name] = fn


def row_reward(
    fn: Callable, extras: list[str] | None = None, **options
) -> Callable[[Column, Column, Column, Column | None], Column]:
    """Wrap `fn(data_source, solution_str, ground_truth, extra_info, **options)` as a column function.

    A number or (number, ...) result becomes `score`; a dict result also fills the named extra fields.
    """
    extras = extras or []
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", *extras)])

    @F.pandas_udf(schema)
    def score(source: pd.Series, solution: pd.Series, truth: pd.Series, info: pd.Series) -> pd.DataFrame:
        rows = []
        for s, x, g, i in zip(source, solution, truth, info):
            result = fn(s, x, g, i, **options)
            if not isinstance(result, dict):
                result = {"score": result[0] if isinstance(result, (tuple, list)) else result}
            rows.append([None if result.get(n) is None else float(result[n]) for n in ("score", *extras)])
        return pd.DataFrame(rows, columns=["score", *extras])

    def column(source: Column, solution: Column, truth: Column, info: Column | None = None) -> Column:
        return score(source, solution, truth, F.lit(None).cast("string") if info is None else info)

    return column


def grouped_reduce(fn: Callable[[pd.Series], float]):
    """A user reduce function over the values of a group as an aggregate.

    The function sees the values of a group together, as its result may not be mergeable (a median).
    `merged_reduce` is the form for results that are.
    """

    @F.pandas_udf(T.DoubleType())
    def reduce_values(values: pd.Series) -> float:
        return float(fn(values))

    return reduce_values


class Mergeable:
    """A user aggregate in four steps; a state is a list of numbers of fixed length.

    `update` takes some values of a group, `merge` two states of the same group in any order, `finish` makes the result.
    """

    def init(self) -> list[float]:
        raise NotImplementedError

    def update(self, state: list[float], values: np.ndarray) -> list[float]:
        raise NotImplementedError

    def merge(self, a: list[float], b: list[float]) -> list[float]:
        raise NotImplementedError

    def finish(self, state: list[float]) -> float | None:
        raise NotImplementedError


class Moments(Mergeable):
    """Count, mean and sum of squared deviations, merged without subtracting large squares; gives the variance or the mean."""

    def __init__(self, variance: bool = True):
        self.variance = variance

    def init(self) -> list[float]:
        return [0.0, 0.0, 0.0]

    def update(self, state: list[float], values: np.ndarray) -> list[float]:
        mean = values.mean()
        return self.merge(state, [float(len(values)), float(mean), float(((values - mean) ** 2).sum())])

    def merge(self, a: list[float], b: list[float]) -> list[float]:
        n = a[0] + b[0]
        if n == 0:
            return a
        apart = b[1] - a[1]
        return [n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n]

    def finish(self, state: list[float]) -> float | None:
        return None if state[0] == 0 else state[2] / state[0] if self.variance else state[1]


HELD = 100_000  # groups whose states a task holds before it passes them on
SPREAD = 64  # tasks that the states of one group are merged in first


def merged_reduce(df: DataFrame, key: str, value: str, aggregate: Mergeable, name: str = "value") -> DataFrame:
    """(key, name): a user aggregate per group, for groups of any size.

    Every task updates states with the values it reads, so a group that holds a third of all rows is spread over all
    tasks and no value is moved.  States are merged in a tree: in SPREAD parts by task, then the parts.  Null values are
    left out; a group of nulls has the result of the first state; a null key is a group.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, task int, state array<double>"
    whole = isinstance(df.schema[key].dataType, T.IntegralType)  # pandas reads whole numbers with nulls as fractions

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        task = TaskContext.get().partitionId() % SPREAD

        def passed_on() -> pd.DataFrame:
            out = pd.DataFrame({key: pd.Series(list(states), dtype=object), "task": task, "state": list(states.values())})
            states.clear()
            return out

        for batch in batches:
            for group, rows in batch.groupby(key, dropna=False, sort=False):
                group = None if pd.isna(group) else int(group) if whole else group
                values = rows[value].dropna().to_numpy()
                state = states.get(group) or aggregate.init()
                states[group] = aggregate.update(state, values) if len(values) else state
            if len(states) > HELD:
                yield passed_on()
        if states:
            yield passed_on()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[:1].copy()
        first["state"] = [functools.reduce(aggregate.merge, [list(s) for s in rows["state"]])]
        return first

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        out = merge(rows)
        return out[[key]].assign(**{name: [aggregate.finish(list(out["state"].iloc[0]))]})

    states = df.select(key, F.col(value).cast("double").alias(value)).mapInPandas(partial, schema)
    parts = states.groupBy(key, "task").applyInPandas(merge, schema)
    return parts.groupBy(key).applyInPandas(finish, f"`{key}` {kind}, `{name}` double")


DATASETS: dict[str, tuple[Callable[..., DataFrame], T.StructType]] = {}


def register_dataset(name: str, transform: Callable[..., DataFrame], schema: T.StructType | str) -> None:
    """A user dataset: a function from a DataFrame (and options) to one of the declared schema."""
    DATASETS[name] = (transform, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def dataset(name: str, df: DataFrame, **options) -> DataFrame:
    """`df` through a registered dataset; columns that are missing or of another type than declared are an error.

    Columns that were not declared are left out.
    """
    transform, schema = DATASETS[name]
    out = transform(df, **options)
    kinds = dict(out.dtypes)
    wrong = [f.name for f in schema if kinds.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise TypeError(f"dataset {name} does not give {', '.join(wrong)} as declared")
    return out.select(*schema.names)


class Generator:
    """Makes new rows between the steps of a run."""

    def generate(self, dataset: DataFrame, batch: DataFrame) -> DataFrame:
        """New rows, of the columns of the dataset, from the dataset so far and the batch of the step that ended."""
        raise NotImplementedError


def grown_dataset(
    steps: DataFrame, start: DataFrame, generator: Generator, keep: Column, path: str, checkpoint: str
) -> DataFrame:
    """`start` and what the generator made after each step of the stream `steps`, as far as `keep` holds (prompt length).

    The rows of a step are appended under its number, so a step that is repeated after a failure adds its rows
    once; the generator sees those of the earlier steps.
    """
    spark, kind = start.sparkSession, start.schema

    def after_step(batch: DataFrame, number: int) -> None:
        so_far = start.unionByName(committed(spark, path, kind, "parquet"))
        made = generator.generate(so_far, batch)
        append_once(made.select(*kind.names).filter(keep), path, f"step-{number}", "parquet")

    query = steps.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(after_step).start()
    query.awaitTermination()
    return start.unionByName(committed(spark, path, kind, "parquet"))


class CurriculumSampler:
    """Re-weights rows from metrics of the last batches; the weight feeds a seeded weighted choice."""

    def __init__(self, key: str, metric: str):
        self.key, self.metric = key, metric
        self.weights: DataFrame | None = None

    def update(self, metrics: DataFrame) -> None:
        """Mean metric per key: hard rows (low metric) weigh more."""
        self.weights = metrics.groupBy(self.key).agg((1 / (F.avg(self.metric) + F.lit(0.1))).alias("weight"))

    def sample(self, df: DataFrame, n: int, seed: int = 0) -> DataFrame:
        """n rows without replacement, each ordered by -log(u) / weight (weighted reservoir keys)."""
        rows = df if self.weights is None else df.join(self.weights, self.key, "left")
        weight = F.coalesce(F.col("weight"), F.lit(1.0)) if self.weights is not None else F.lit(1.0)
        order = -F.log(unit_digest(seed, self.key) + F.lit(1e-12)) / weight
        return rows.orderBy(order, self.key).limit(n).select(*df.columns)


__all__ = [
    "CurriculumSampler",
    "Generator",
    "Mergeable",
    "Moments",
    "dataset",
    "grouped_reduce",
    "grown_dataset",
    "load_function",
    "merged_reduce",
    "register_dataset",
    "register_estimator",
    "register_loss",
    "register_reward",
    "row_reward",
]
