"""Order-dependent folds that round at every step and therefore have no combinable form."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame


def round4(value: float) -> float:
    return math.floor(value * 10000.0 + 0.5) / 10000.0


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    start: Callable[[], object],
    step: Callable[[object, dict], tuple[object, tuple]],
    schema: str,
) -> DataFrame:
    """``step(state, row) -> (state, output values)`` along ``order`` within each key, one output row per input row.

    Rows are hash-partitioned by key and sorted, then streamed: a task holds one batch and one state, never a whole
    group.  The fold itself is serial per key; where the rounding of intermediate results does not matter use
    ``ranking.running_sums``, which splits a hot key.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            rows = []
            for values in pdf.itertuples(index=False, name=None):
                row = dict(zip(columns, values))
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, start()
                state, out = step(state, row)
                rows.append((*key, *out))
            yield pd.DataFrame(rows, columns=names)

    from pyspark.sql.types import StructType

    key_schema = [f for f in df.schema.fields if f.name in keys]
    full = StructType(sorted(key_schema, key=lambda f: list(keys).index(f.name)) + StructType.fromDDL(schema).fields)
    names = full.fieldNames()
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, full)
