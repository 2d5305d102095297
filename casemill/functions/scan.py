"""Sequential scan of ordered keys with bounded memory.

Some rules depend on their own earlier decisions (a throttle counts only accepted events), which no
window function expresses. Rows are placed by key, sorted inside the partition, and streamed in Arrow
batches; the scan keeps one small state per running key, never a whole group.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# Executors need not have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sequential_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Any],
    step: Callable[[Any, Any], tuple],
    added: StructType,
) -> DataFrame:
    """Append the ``added`` columns, computed by ``step(state, row)`` in key and time order.

    ``start`` makes the state of a new key; ``step`` may change it in place and returns the values
    of the added columns.
    """
    keys, names = list(keys), [f.name for f in added.fields]
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, start()
                rows.append(step(state, row))
            out = batch.copy()
            for i, name in enumerate(names):
                out[name] = [r[i] for r in rows]
            yield out

    return ordered.mapInPandas(run, StructType([*df.schema.fields, *added.fields]))


def running_fold(
    df: DataFrame, keys: Sequence[str], value: str, start: str, combine: Callable[[str, str], str], before: str, after: str
) -> DataFrame:
    """Fold the strings of ``value`` per key, in the order in which the rows of each partition come.

    ``before`` holds the result over the earlier rows of the key in the same partition (``start`` for its
    first), ``after`` that with the row itself. Other columns pass through unread.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, folded = None, start
        for batch in batches:
            earlier, later = [], []
            rows = zip(batch.column(value).to_pylist(), *(batch.column(k).to_pylist() for k in keys))
            for item, *key in rows:
                if key != current:
                    current, folded = key, start
                earlier.append(folded)
                folded = combine(folded, item)
                later.append(folded)
            added = [pa.array(earlier, pa.string()), pa.array(later, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, before, after])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(before, StringType()), StructField(after, StringType())]))
