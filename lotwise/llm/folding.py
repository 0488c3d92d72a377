"""Fixed-size arrays added up over all partitions, slice by slice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLICES = 64


def total(df: DataFrame, columns: list[str], size: int, mark: Callable[[np.ndarray, pd.DataFrame], None]) -> np.ndarray:
    """An int32 array of ``size`` that ``mark(array, frame)`` adds to for each frame of ``columns``.

    Its size is fixed whatever the data, so it may be held by the driver and sent to all tasks. Many
    partitions' arrays are added up in levels, so that no task reads a slice of all of them.
    """
    parts = df.rdd.getNumPartitions()
    levels = [] if parts <= 64 else [32] if parts <= 2048 else [1024, 32]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(size, dtype=np.int32)
        some = False
        for frame in batches:
            if len(frame):
                some = True
                mark(out, frame)
        if some:
            yield pd.DataFrame({"slice": range(_SLICES), "part": TaskContext.get().partitionId(), "data": [x.tobytes() for x in np.array_split(out, _SLICES)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(d, dtype=np.int32).astype(np.int64) for d in group["data"])
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": group["part"].iloc[:1], "data": [np.minimum(whole, 2**31 - 1).astype(np.int32).tobytes()]})

    schema = "slice int, part int, data binary"
    summed = df.select(*columns).mapInPandas(run, schema)
    for width in [*levels, 1]:
        summed = summed.withColumn("part", F.pmod("part", F.lit(width))).groupBy("slice", "part").applyInPandas(add, schema)
    rows = summed.collect()
    if not rows:
        return np.zeros(size, dtype=np.int32)
    return np.concatenate([np.frombuffer(r.data, dtype=np.int32) for r in sorted(rows, key=lambda r: r.slice)])
