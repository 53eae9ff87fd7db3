"""Sequential folds per key, for decisions in which accepting one row changes the next row's outcome."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: step(state, row) -> (next state, values of the output columns); the state is None at a key's first row.
Step = Callable[[Any, Sequence], tuple[Any, tuple]]


def ordered_fold(rows: DataFrame, key: str, order: list[str], step: Step, adds: str, reads: list[str]) -> DataFrame:
    """Run `step` over each key's rows in order and append its results as columns `adds` (a schema string).

    A key's rows meet in one task and come sorted, so only the key's state is held, however many rows it has: Spark
    spills what does not fit, and nothing is collected. The step sees the columns `reads` of each row, in this order; the
    others pass through as Arrow columns.
    """
    added = to_arrow_schema(StructType.fromDDL(adds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, seen = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            begins = np.diff(keys.dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1) != 0
            begins[0] = not seen or keys[0].as_py() != last
            last, seen, out = keys[-1].as_py(), True, []
            for new, *row in zip(begins.tolist(), *(batch.column(c).to_pylist() for c in reads), strict=True):
                state, values = step(None if new else state, row)
                out.append(values)
            results = [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *results], names=[*batch.schema.names, *added.names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, StructType([*rows.schema, *StructType.fromDDL(adds)]))
