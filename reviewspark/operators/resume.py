"""Going on after an interruption: what is left to do, and merging old with new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `todo` whose key is not among `done`."""
    return todo.join(done.select(*keys), keys, "left_anti")


def merge_checkpoint(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All keys of both, the new value where there is one."""
    return (
        old.select(*keys, F.col(value).alias("_old"))
        .join(new.select(*keys, F.col(value).alias("_new")), keys, "full")
        .select(*keys, F.coalesce("_new", "_old").alias(value))
    )


def lookup(df: DataFrame, values: DataFrame, keys: list[str], defaults: dict[str, str]) -> DataFrame:
    """Left join on keys with a default for every missing value."""
    found = df.join(values.select(*keys, *defaults), keys, "left")
    return found.fillna(defaults)
