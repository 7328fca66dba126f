"""Folds over the rows of a key in their order, for tables and for streams.

A fold is a pair of plain functions: `start()` makes a key's state, a dict of JSON
values, and `step(state, row)` changes it and returns the rows to give out. The
same pair runs over a table, where the rows of a task are sorted by key and read
one after the other, so only one key's state is held, and over a stream, where
the state is kept between micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, dict], list]


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Step, schema: str, finish: Step | None = None) -> DataFrame:
    """What `step` gives for each row, and `finish(state, key)` for each key.

    Rows of a key follow each other in `order`; a key is one task's, but is read
    as a stream, so aggregate rows to the steps that matter first. Output rows are
    dicts that need not repeat the keys.
    """
    out_schema = to_arrow_schema(_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if state is None or own != key:
                    if state is not None and finish:
                        out += [dict(zip(keys, key)) | r for r in finish(state, dict(zip(keys, key)))]
                    key, state = own, start()
                out += [dict(zip(keys, own)) | r for r in step(state, row)]
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)
        if state is not None and finish:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key)) | r for r in finish(state, dict(zip(keys, key)))], schema=out_schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Step, schema: str) -> DataFrame:
    """The same over a streaming DataFrame, in append mode: rows of a micro-batch in `order`, micro-batches as they come."""
    names = [f.name for f in _schema(schema)]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else start()
        frame = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        clean = frame.astype(object).where(frame.notna(), None)
        out = []
        for row in clean.to_dict("records"):
            out += [dict(zip(keys, key)) | r for r in step(own, row)]
        state.update((json.dumps(own),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
