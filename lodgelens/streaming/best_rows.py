"""The best row per key of a stream, with corrections when a better one arrives late."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodgelens.operators.ranking import keep_first
from lodgelens.session import stored_bytes
from lodgelens.streaming.drain import drain_batches

CHANGE = "_change_type"
INSERT, BEFORE, AFTER = "insert", "update_preimage", "update_postimage"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _place(value) -> tuple:
    """Spark's ascending order for one value: nulls first, NaN last."""
    if value is None:
        return (0, 0)
    return (2, 0) if value != value else (1, value)


class KeepBest(StatefulProcessor):
    """Holds one row per key and gives out what changes: a first row, or the row before and after."""

    def __init__(self, schema: T.StructType, order: list[str]):
        self.schema = schema
        names = schema.fieldNames()
        self.at = [names.index(c) for c in order]
        self.change = Row(*names, CHANGE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("best", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place = lambda row: [_place(row[i]) for i in self.at]
        best = min((tuple(r) for r in rows), key=place)
        before = self.held.get()  # one call to the state store; None without a row
        if before is None:
            yield self.change(*best, INSERT)
        else:
            before = tuple(before)
            if not place(best) < place(before):
                return
            yield self.change(*before, BEFORE)
            yield self.change(*best, AFTER)
        self.held.update(best)

    def close(self) -> None:
        pass


def _codes(column: pa.Array) -> list[np.ndarray]:
    """Integer columns that sort like ``column`` in Spark: valid, NaN, rank."""
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    nan = np.zeros(len(column), bool)
    if pa.types.is_floating(column.type):
        nan = pc.fill_null(pc.is_nan(column), False).to_numpy(zero_copy_only=False)
    if pa.types.is_boolean(column.type):
        column = column.cast(pa.int8())
    return [valid, nan, pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()]


def first_of_batch(batch: pa.RecordBatch, keys: list[str], order: list[str]) -> pa.RecordBatch:
    """The first row of every key in one Arrow batch."""
    if not batch.num_rows:
        return batch
    key = np.column_stack([x.astype(np.int64) for k in keys for x in _codes(batch[k])])
    _, group = np.unique(key, axis=0, return_inverse=True)
    group = group.reshape(-1)
    by = np.lexsort([*reversed([x for c in order for x in _codes(batch[c])]), group])
    first = by[np.append(True, group[by][1:] != group[by][:-1])]
    return batch.take(pa.array(np.sort(first)))


def best_changes(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Changes of the best row per key: the columns of ``stream`` and ``_change_type``.

    The best row is the first in ``order`` (ascending, nulls first; of equal ones the first that
    arrived, so end ``order`` with an id); null keys are equal. A key's first row is an insert; a better
    row that comes later gives the row it replaces and itself. Anything else gives nothing. The state is
    one row per key, and a batch touches the state of its own keys only. Copies are reduced to one row per
    key and Arrow batch before the shuffle, so a hot key sends one row in thousands.
    """
    times = [f.name for f in stream.schema if isinstance(f.dataType, T.TimestampType)]
    plain = stream.withColumns({c: F.unix_micros(c) for c in times})
    schema = plain.schema

    def combine(batches):
        for batch in batches:
            yield first_of_batch(batch, keys, order)

    processor = KeepBest(schema, order)
    wide = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), T.StructField(CHANGE, T.StringType())])
    thin = plain.mapInArrow(combine, schema)
    found = thin.groupBy(*keys).transformWithState(processor, wide, "append", "none")
    return found.withColumns({c: F.timestamp_micros(c) for c in times})


def drain_best(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str) -> DataFrame:
    """Bring the change log under ``path`` up to date and return the best row of every key.

    Each batch has its own folder and overwrites it when it is repeated. A key's rows only get better,
    so the log's best row is the current one whatever the order of its files.
    """
    spark = stream.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # arbitrary state needs it
    try:
        drain_batches(best_changes(stream, keys, order), store, checkpoint)
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return best_rows(read_changes(spark, path, stream.schema), keys, order).select(*stream.columns)


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The change log of ``drain_best`` with the number of the batch; empty before the first one."""
    schema = T.StructType([*schema, T.StructField(CHANGE, T.StringType()), T.StructField("batch", T.LongType())])
    if not stored_bytes(spark, f"{path}/batch=*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def best_rows(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The current row of every key from a change log."""
    return keep_first(changes.filter(F.col(CHANGE) != BEFORE), keys, [F.col(c) for c in order])
