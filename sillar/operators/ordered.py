"""Running sums over groups of any size.

A window over a group runs in one task. Here the rows are range-partitioned by group and
order, each partition sums up its own stretch, and the sums of the stretches before are
added: a group with a third of all rows is spread over a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillar.session import cut, shuffle_width

#: Up to so many offsets (some 50 bytes each) are broadcast.
FEW = 200_000


def _local(group: str, value: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        current, carried = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_rows
            groups = b.column(b.schema.get_field_index(group))
            codes = pc.dictionary_encode(groups).indices.to_numpy(zero_copy_only=False)
            values = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64) if value else np.ones(n, dtype=np.int64)
            fresh = np.concatenate([[groups[0].as_py() != current], codes[1:] != codes[:-1]])
            ahead = np.cumsum(values) - values
            begins = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            sums = np.where(begins < 0, ahead + carried, ahead - ahead[np.maximum(begins, 0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(sums)], names=[*b.schema.names, "__part", "__ahead"])
            current, carried = groups[n - 1].as_py(), int(sums[-1] + values[-1])

    return run


def running_sum(rows: DataFrame, group: str, order: list[str], value: str | None = None, name: str = "before", few: int = FEW) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (or the count) over the rows of the group
    that come before. ``group`` must not be null; ``order`` should be unique in a group,
    else equal rows come in any order. Up to ``few`` offsets, one for each stretch, are sent to all executors; more are
    joined."""
    keys = [group, *order]
    ordered = rows.repartitionByRange(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = cut(ordered.mapInArrow(_local(group, value), f"{fields}, __part int, __ahead long"))
    weight = F.col(value) if value else F.lit(1)
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy(group, "__part").agg(F.sum(weight).alias("__n")).select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    offsets = cut(offsets)
    if offsets.count() <= few:
        offsets = F.broadcast(offsets)
    return local.join(offsets, [group, "__part"]).withColumn(name, F.col("__offset") + F.col("__ahead")).drop("__part", "__ahead", "__offset")
