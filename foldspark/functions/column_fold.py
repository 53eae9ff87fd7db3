"""Sequential folds of many keys at once: the first rows of all keys are decided together in numpy, then the second ones, ...

Keys are taken by falling number of rows, so the keys that still have a k-th row are the first ones of all arrays. When only
FEW_KEYS are left, which have long tails, their rows are decided one by one, which is faster for so few. The rows of a key
come sorted into one task and only its state is held from one batch to the next; a hot key is one task's work, because
each row's outcome needs the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FEW_KEYS = 24
#: A number that stands for null among the results.
NOTHING = int(np.iinfo(np.int64).min)

Arrays = tuple[np.ndarray, ...]


class Decision(NamedTuple):
    """How rows are decided.

    reads: the columns that are seen; strings as codes into `labels`, unknown ones and nulls -1; other nulls as 0, with the mask
    of what is valid as a column of its own, named `<column>?`. adds: the result's columns, a schema string; strings as codes.
    start(columns) is the state at each key's first row, decide(state, columns) gives the next state and the results, step
    the same for one row, given and returning plain numbers, so both must agree.
    """

    reads: Sequence[str]
    adds: str
    labels: dict[str, tuple[str, ...]]
    start: Callable[[dict[str, np.ndarray]], Arrays]
    decide: Callable[[Arrays, dict[str, np.ndarray]], tuple[Arrays, Arrays]]
    step: Callable[[tuple, dict[str, Any]], tuple[tuple, tuple]]


def _columns(batch: pa.RecordBatch, d: Decision) -> dict[str, np.ndarray]:
    out = {}
    for c in d.reads:
        values = batch.column(c)
        out[f"{c}?"] = values.is_valid().to_numpy(zero_copy_only=False)
        if c in d.labels:
            out[c] = pc.fill_null(pc.index_in(values, pa.array(d.labels[c])), -1).to_numpy(zero_copy_only=False).astype(np.int8)
        else:
            filled = pc.fill_null(values, False if pa.types.is_boolean(values.type) else 0)
            out[c] = filled.to_numpy(zero_copy_only=False)
    return out


def fold_rows(begins: np.ndarray, columns: dict[str, np.ndarray], d: Decision, carried: tuple | None, few: int = FEW_KEYS) -> tuple[list[np.ndarray], tuple]:
    """(results, last key's state) for rows of keys that begin at `begins`; the first key goes on from `carried`, if given."""
    n = len(next(iter(columns.values())))
    sizes = np.diff(np.r_[begins, n])
    order = np.argsort(-sizes, kind="stable")
    first, sizes = begins[order], sizes[order]
    state = [a.copy() for a in d.start({c: v[first] for c, v in columns.items()})]
    if carried is not None:
        at = int(np.flatnonzero(order == 0)[0])
        for a, v in zip(state, carried, strict=True):
            a[at] = v
    results: list[np.ndarray] | None = None
    k, live = 0, len(first)
    while live > few or (live and results is None):
        rows = first[:live] + k
        new, told = d.decide(tuple(a[:live] for a in state), {c: v[rows] for c, v in columns.items()})
        for a, v in zip(state, new, strict=True):
            a[:live] = v
        if results is None:
            results = [np.zeros(n, t.dtype) for t in told]
        for r, t in zip(results, told, strict=True):
            r[rows] = t
        k += 1
        live = int(np.searchsorted(-sizes, -k))  # sizes above k
    for i in range(live):
        begin, end = int(first[i]) + k, int(first[i] + sizes[i])
        one = tuple(a[i].item() for a in state)
        some = {c: v[begin:end].tolist() for c, v in columns.items()}
        rows = []
        for values in zip(*some.values(), strict=True):
            one, told = d.step(one, dict(zip(some, values, strict=True)))
            rows.append(told)
        for r, t in zip(results, zip(*rows, strict=True), strict=True):
            r[begin:end] = t
        for a, v in zip(state, one, strict=True):
            a[i] = v
    last = int(np.flatnonzero(order == len(order) - 1)[0])
    return results, tuple(a[last].item() for a in state)


def column_fold(rows: DataFrame, key: str, order: list[str], d: Decision) -> DataFrame:
    """The rows with the decision's columns added. A result is null where its code is -1 or its number NOTHING."""
    added = StructType.fromDDL(d.adds)
    fields = list(to_arrow_schema(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, seen = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            new = np.diff(keys.dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1) != 0
            goes_on = seen and keys[0].as_py() == last
            told, state = fold_rows(np.flatnonzero(new), _columns(batch, d), d, state if goes_on else None)
            last, seen = keys[-1].as_py(), True
            results = []
            for f, t in zip(fields, told, strict=True):
                if f.name in d.labels:
                    codes = pa.array(t.astype(np.int32), mask=t < 0)
                    results.append(pc.take(pa.array(d.labels[f.name]), codes))
                else:
                    results.append(pa.array(t.astype(np.int64), mask=t == NOTHING).cast(f.type))
            yield pa.RecordBatch.from_arrays([*batch.columns, *results], names=[*batch.schema.names, *(f.name for f in fields)])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, StructType([*rows.schema, *added]))
