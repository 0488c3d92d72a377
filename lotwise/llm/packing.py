"""Filling fixed-capacity containers with texts by the sum-of-squares rule.

Each text goes where the sum of the squared counts of open bins per residual gap becomes smallest.
The rule is sequential, so documents are spread by hash over blocks of about ``block`` texts that
are packed on their own: a block's waste is a few bins, which its many full bins make negligible.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size (1 to ``capacity``), in the order given; ties take the smaller gap left."""
    # into[h]: what one more bin of gap h adds; out[g]: what one bin less of gap g takes away.
    # Full bins don't count. An unused bin, of gap ``capacity``, is always at hand.
    into = np.ones(capacity + 1)
    into[0] = 0.0
    out = np.full(capacity + 1, -np.inf)
    out[capacity] = 0.0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(sizes), dtype=np.int64)
    used = 0
    for i, size in enumerate(sizes.tolist()):
        left = int((into[: capacity + 1 - size] - out[size:]).argmin())
        gap = left + size
        if gap == capacity:
            b = used
            used += 1
        else:
            b = open_bins[gap].pop()
            n = len(open_bins[gap])
            into[gap] = 2 * n + 1
            out[gap] = 2 * n - 1 if n else -np.inf
        bins[i] = b
        if left:
            open_bins[left].append(b)
            n = len(open_bins[left])
            into[left] = 2 * n + 1
            if left != capacity:
                out[left] = 2 * n - 1
    return bins


def pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece, size): texts beyond the capacity cut into full pieces and a rest, others whole."""
    count = np.maximum(1, -(-sizes // capacity))
    item = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(capacity, sizes[item] - piece * capacity)
    return item, piece, size


def pack(documents: DataFrame, key: str, size: str, containers: DataFrame, container: str, capacity: str, block: int = 20_000) -> DataFrame:
    """(container, bin, key, piece, tokens): where each text lies, for each kind of container.

    ``size`` is in whole units; null, zero and negative sizes take no room and get no row. A text
    is divided only if it is longer than the capacity, pieces counting from 0. Equal rows are packed
    each. ``containers`` is a small reference table; capacities below 1 and nulls are left out.
    Key and size spread the work, so no pair of them may hold more rows than fit one task.
    """
    kinds = [(r[0], int(r[1])) for r in containers.select(container, capacity).filter(F.col(capacity) >= 1).distinct().collect()]
    kinds.sort()
    types = dict(documents.dtypes)
    ids = dict(containers.dtypes)[container]
    sized = documents.filter(F.col(size) >= 1).select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size"))
    blocks = max(1, math.ceil(documents.count() / block))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "key"])
        keys, sizes, base = group["key"].to_numpy(), group["size"].to_numpy(), int(group["block"].iloc[0]) << 32
        parts = []
        for name, most in kinds:
            item, piece, length = pieces(sizes, most)
            parts.append(pd.DataFrame({"c": name, "bin": base + sum_of_squares(length, most), "key": keys[item], "piece": piece, "tokens": length}))
        return pd.concat(parts)

    hashed = F.xxhash64("key", "size", F.lit(7))
    placed = (
        sized.withColumn("order", hashed)
        .withColumn("block", F.pmod(hashed, F.lit(blocks)))
        .repartition(blocks, "block")  # few bytes, but much work: not to be put together in one task
        .groupBy("block")
        .applyInPandas(run, f"c {ids}, bin bigint, key {types[key]}, piece int, tokens bigint")
    )
    return placed.withColumnsRenamed({"c": container, "key": key})


def fill(placed: DataFrame, containers: DataFrame, container: str, capacity: str) -> DataFrame:
    """By kind of container: bins used, the least that could do, tokens, and the share filled."""
    by = placed.groupBy(container).agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    kinds = containers.select(container, F.col(capacity).cast("bigint").alias("capacity_tokens")).distinct()
    return by.join(kinds, container).select(
        container,
        "capacity_tokens",
        "bins",
        "tokens",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"),
        (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("filled"),
    )
