"""True folds: per-row state machines that do not compose associatively.

Rows are hash-partitioned on the keys and sorted by the engine (the sort
spills), then stream once through a task.  The state of one key is a few
numbers, so memory does not grow with the length of a series; the number of
keys (symbol, island, account, parameter set) gives the parallelism.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

RowFn = Callable[[tuple], Iterable[tuple]]


class Machine:
    """One key's state.  ``row`` and ``end`` yield output tuples (keys excluded)."""

    def row(self, *values):
        return ()

    def end(self):
        return ()


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], cols: list[str], make: Callable[[], Machine], out: str) -> DataFrame:
    """Run a :class:`Machine` per key over rows in ``order``; ``out`` is the DDL
    of the emitted columns, which follow the keys in the result."""
    from pyspark.sql import SparkSession  # noqa: F401  (a session must be active to parse DDL)

    fields = [df.schema[k] for k in keys] + list(_parse_datatype_string(out).fields)
    schema = StructType(fields)
    arrow = to_arrow_schema(schema)
    nk = len(keys)

    def go(batches):
        key, m = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            ks = list(zip(*[b.column(i).to_pylist() for i in range(nk)]))
            vs = zip(*[b.column(i).to_pylist() for i in range(nk, b.num_columns)])
            got = []
            for k, v in zip(ks, vs):
                if k != key:
                    if m is not None:
                        got.extend(key + tuple(o) for o in m.end())
                    key, m = k, make()
                got.extend(k + tuple(o) for o in m.row(*v))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got), arrow)], schema=arrow)
        if m is not None:
            got = [key + tuple(o) for o in m.end()]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got), arrow)], schema=arrow)

    laid = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *cols)
    return laid.mapInArrow(go, schema)
