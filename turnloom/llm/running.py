"""Running sums over a whole table in one range shuffle.

Rows are dealt to ranges of the order, sorted there, and summed locally while they stream; then one row per range carries the sums of the ranges
before it.  No task sees more than its range, whatever the number of rows of one key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from turnloom.llm.common import fresh, staged


def running_sums(df: DataFrame, order: list[Column], values: list[str], what: str) -> tuple[DataFrame, str, list[str]]:
    """``df`` with the sums of the long columns ``values`` over all rows before a row, and the number of the row's range; names of both are returned.

    ``order`` should tell all rows apart that are not interchangeable.
    """
    part, *before = fresh(df, "part", *[f"{v}_before" for v in values])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns

    def local(batches):
        done = [0] * len(values)
        mine = TaskContext.get().partitionId()
        for b in batches:
            cols = [b.column(i) for i in range(len(names))] + [pa.array(np.full(b.num_rows, mine, np.int32))]
            for i, v in enumerate(values):
                x = b.column(names.index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(x) + done[i]
                cols.append(pa.array(upto - x))
                done[i] = int(upto[-1]) if len(upto) else done[i]
            yield pa.RecordBatch.from_arrays(cols, [*names, part, *before])

    schema = StructType([*df.schema.fields, StructField(part, IntegerType()), *[StructField(b, LongType()) for b in before]])
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = staged(ranged.mapInArrow(local, schema), what)
    # one row per range
    sums = rows.groupBy(F.col(part).alias("p")).agg(*[F.sum(v).alias(f"s{i}") for i, v in enumerate(values)])
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("p", *[F.coalesce(F.sum(f"s{i}").over(w), F.lit(0)).alias(f"c{i}") for i in range(len(values))])
    carried = rows.join(F.broadcast(carry), F.col(part) == F.col("p"))  # as many rows as there are shuffle partitions
    new = {b: F.col(b) + F.col(f"c{i}") for i, b in enumerate(before)}
    return carried.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in rows.columns]), part, before
