"""Places of rows in a whole order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import keep


def numbered(df: DataFrame, by: str, order: list[str | Column], kept: list[Column | str], name: str) -> DataFrame:
    """The columns ``kept`` (``by`` among them, which isn't null) and ``name``, each row's place from 0 within ``by`` in ``order``; written once.

    Rows are dealt by ranges of the whole order, so that a group of any size is spread over tasks; what it has in earlier ranges is added
    from a table of at most one row for each border between ranges. Rows that ``order`` leaves equal get places of their own.
    """
    rows = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).select(*kept)
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, gone = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(by)
            n = len(key)
            new = np.concatenate([[0], np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1])
            at = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
            if key[0].as_py() == last:
                at[: new[1] if len(new) > 1 else n] += gone
            last, gone = key[n - 1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(at)], [*names, "part_", "at_"])

    out = keep(rows.mapInArrow(number, StructType([*rows.schema, StructField("part_", IntegerType()), StructField("at_", LongType())])), "numbered")
    parts = out.groupBy(by, "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = parts.select(by, "part_", (F.sum("n_").over(Window.partitionBy(by).orderBy("part_")) - F.col("n_")).alias("before_")).where("before_ > 0")
    return out.join(F.broadcast(before), [by, "part_"], "left").select(*names, (F.col("at_") + F.coalesce("before_", F.lit(0))).alias(name))
