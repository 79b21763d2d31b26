"""Aggregates with a state of the user's own, and functions that see a product with its themes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewspark.operators.ranking import chunk_numbers

# States a task holds before it passes them on.
HELD = 10_000
# Parts that the states of one key are merged in before the last merge.
FAN = 32


class Fold(Protocol):
    """What `fold_groups` needs: how a state begins, takes rows, joins another, and ends.

    `merge` must not depend on the order of its states, and a state must stay small whatever
    the number of rows: it is what a task holds and sends for a key.
    """

    def begin(self) -> Any: ...
    def update(self, state: Any, rows: pa.RecordBatch) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> dict: ...


def rows_of_each(keys: list[pa.Array]) -> Iterator[tuple[tuple, pa.Array]]:
    """(key, places of its rows) for every distinct key of some columns; null is a key like others."""
    code = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        coded = k.dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(order)]):
        yield tuple(k[int(order[lo])].as_py() for k in keys), pa.array(order[lo:hi])


def fold_groups(
    df: DataFrame, keys: list[str], values: list[str], fold: Fold, schema: str, fan: int = FAN, held: int = HELD
) -> DataFrame:
    """(keys, columns of `schema`): a user's aggregate, one row for each distinct key.

    Every task folds its own Arrow batches, one state a key, so a hot key leaves a task as
    one small state. The states of a key are merged in `fan` parts first, then those parts:
    no task gets the rows of a group, and none more than a share of its states. A task that
    meets more than `held` keys passes its states on and starts anew.

    Nulls reach the fold as they are; a null key is a key. No rows, no groups. Column names
    of `schema` that a key has already are not allowed.
    """
    if not keys:
        raise ValueError("a fold needs keys")
    key_kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    partial = f"{key_kinds}, _part int, _state binary"

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Any] = {}
        sent, task, types = 0, TaskContext.get().partitionId(), []

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in found], types[i]) for i in range(len(keys))]
            # States of one key from several tasks, or from one task at several times, fall to different parts.
            part = pa.array([(task * 31 + sent) % fan] * len(found), pa.int32())
            return pa.RecordBatch.from_arrays([*columns, part, pa.array([pickle.dumps(s) for s in found.values()], pa.binary())],
                                              [*keys, "_part", "_state"])

        for b in batches:
            types = [b.column(k).type for k in keys]
            rest = b.select(values)
            for key, at in rows_of_each([b.column(k) for k in keys]) if b.num_rows else ():
                if key not in found and len(found) >= held:
                    yield out()
                    found, sent = {}, sent + 1
                found[key] = fold.update(found[key] if key in found else fold.begin(), rest.take(at))
        if found:
            yield out()

    def joined(table: pa.Table) -> Any:
        state = None
        for i, s in enumerate(table.column("_state")):
            state = pickle.loads(s.as_buffer()) if i == 0 else fold.merge(state, pickle.loads(s.as_buffer()))
        return state

    def first(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).set_column(table.schema.get_field_index("_state"), "_state", pa.array([pickle.dumps(joined(table))], pa.binary()))

    out_types = df.sparkSession.createDataFrame([], schema).schema
    names, arrow = out_types.fieldNames(), [to_arrow_type(f.dataType) for f in out_types]
    if set(names) & set(keys):
        raise ValueError("a result column has the name of a key")

    def last(table: pa.Table) -> pa.Table:
        told = fold.finish(joined(table))
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), *(pa.array([told[n]], t) for n, t in zip(names, arrow))],
                        [*keys, *names])

    parts = df.select(*keys, *[v for v in values if v not in keys]).mapInArrow(states, partial)
    parts = parts.groupBy(*keys, "_part").applyInArrow(first, partial)
    return parts.groupBy(*keys).applyInArrow(last, f"{key_kinds}, {schema}")


class TopValues:
    """The k largest values of a column with how many rows have each and the smallest id among them.

    Rows without a value take no part.
    """

    def __init__(self, value: str, id_col: str, k: int):
        self.value, self.id_col, self.k = value, id_col, k

    def begin(self) -> dict:
        return {}

    def update(self, state: dict, rows: pa.RecordBatch) -> dict:
        value, id_ = rows.column(self.value), rows.column(self.id_col)
        found = pa.table([value, id_], ["v", "i"]).filter(value.is_valid()).group_by("v").aggregate([("v", "count"), ("i", "min")])
        largest = found.take(pc.select_k_unstable(found, self.k, [("v", "descending")]))
        for v, n, i in zip(*(largest.column(c).to_pylist() for c in ("v", "v_count", "i_min"))):
            self._add(state, v, n, i)
        return state

    def merge(self, a: dict, b: dict) -> dict:
        for value, (n, id_) in b.items():
            self._add(a, value, n, id_)
        return a

    def _add(self, state: dict, value: Any, n: int, id_: Any) -> None:
        had, first = state.get(value, (0, None))
        state[value] = had + n, min((x for x in (first, id_) if x is not None), default=None)
        if len(state) > self.k:
            del state[min(state)]

    def finish(self, state: dict) -> dict:
        return {"top": [{"value": v, "n": n, "first_id": i} for v, (n, i) in sorted(state.items(), reverse=True)]}


class Merged:
    """Lists of a column as one list in order, up to `most` elements; the smallest stay."""

    def __init__(self, value: str, most: int):
        self.value, self.most = value, most

    def begin(self) -> list:
        return []

    def update(self, state: list, rows: pa.RecordBatch) -> list:
        return sorted([*state, *(x for cell in rows.column(self.value).to_pylist() for x in cell or () if x is not None)])[: self.most]

    def merge(self, a: list, b: list) -> list:
        return sorted(a + b)[: self.most]

    def finish(self, state: list) -> dict:
        return {self.value: state}


def with_themes(
    rows: DataFrame, themes: DataFrame, key: str, order: str, make: Callable[[tuple, pa.Table, pa.Table], pa.Table],
    schema: str, most: int = 100_000,
) -> DataFrame:
    """What `make` returns for each product: it gets (product, slice), the product's rows and its themes.

    A product of more than `most` rows is cut into slices of at most that many, numbered by
    `order`, and every slice gets all themes of its product; so the results of a product are
    parts that the caller adds up. The largest task holds `most` rows, however large a
    product is. Products without themes get an empty table, themes without rows no call.
    Rows with a null `key` are a product of their own, which has no themes.
    """
    sliced = chunk_numbers(rows, [key], order, most).withColumnRenamed("chunk_no", "_slice")
    last = F.floor((F.col("_n") - 1) / most).cast("bigint")
    held = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_slice"))
    theirs = themes.join(held, key)
    return sliced.groupBy(key, "_slice").cogroup(theirs.groupBy(key, "_slice")).applyInArrow(
        lambda k, a, b: make(tuple(x.as_py() for x in k), a, b), schema)
