"""Quantities recorded in different units, converted to one canonical unit.

The grammar (:mod:`lotwise.functions.quantity`) runs in Arrow batches, once for each distinct
writing of a batch; everything after it is native: rates and countries are joined, and the bare
weights of a lot are scaled by a total that is pre-aggregated before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import quantity
from lotwise.functions.memo import struct_udf

_MONEY = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("currencies", T.ArrayType(T.StringType()))])
_WEIGHT = T.StructType([T.StructField("basis_points", T.DoubleType()), T.StructField("bare", T.DoubleType())])


def parsed_money(value: Column, currency: Column | None = None) -> Column:
    """struct<amount, currencies> of a written amount and, if given, the currency field beside it.

    Null, empty and wordy values give nulls.
    """
    text = value if currency is None else F.concat(value, F.lit("\x1f"), F.coalesce(currency, F.lit("")))
    return struct_udf(quantity.money, _MONEY)(text)


def parsed_weight(value: Column) -> Column:
    """struct<basis_points, bare> of a criterion's weight; nulls for ranks, words, null and empty."""
    return struct_udf(quantity.weight, _WEIGHT)(value)


def in_euros(df: DataFrame, parsed: str, country: str, countries: DataFrame, rates: DataFrame, out: str = "qty") -> DataFrame:
    """Rows of ``df`` that state an amount, with ``out`` in whole euros.

    Where no currency is stated it is that of the country; a sign several currencies share is
    settled by the country too, else by the first of them. Rows without an amount, with a currency
    that has no rate, or with neither a currency nor a known country are left out. Extra columns
    stay as they are; ``countries`` and ``rates`` are small reference tables (a row a country, a
    row a currency), which is why they are joined by broadcast.
    """
    of = countries.groupBy(F.col("country").alias("__country")).agg(F.min("currency").alias("__own"))
    rate = rates.groupBy(F.col("currency").alias("__currency")).agg(F.min("eur_per_unit").alias("__rate"))
    said = F.col(f"{parsed}.currencies")
    chosen = (
        F.when(F.size(said) == 0, F.col("__own"))
        .when((F.size(said) > 1) & F.array_contains(said, F.col("__own")), F.col("__own"))
        .otherwise(F.get(said, F.lit(0)))
    )
    return (
        df.filter(F.col(f"{parsed}.amount").isNotNull())
        .join(F.broadcast(of), F.col(country) == F.col("__country"), "left")
        .withColumn("__currency_of", chosen)
        .join(F.broadcast(rate), F.col("__currency_of") == F.col("__currency"))
        .withColumn(out, F.round(F.col(f"{parsed}.amount") * F.col("__rate")).cast("bigint"))
        .drop("__country", "__own", "__currency_of", "__currency", "__rate")
    )


def in_basis_points(df: DataFrame, weight: str, lot: list[str], seq: str, out: str = "qty") -> DataFrame:
    """Rows of ``df`` that state a weight, with ``out`` in basis points of the lot's total.

    A weight with a scale of its own stands alone. The bare numbers of one lot add up to its whole,
    each ``seq`` counted once (repeated rows have the same number). A bare number without a lot or
    in a lot that adds up to zero is left out, as are ranks, words, null and empty weights.
    """
    rows = df.withColumn("__w", parsed_weight(F.col(weight)))
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(lot)]
    names = [f"__k{i}" for i in range(len(lot))]
    total = (
        rows.filter(F.col("__w.bare").isNotNull())
        .groupBy(*keys, F.col(seq).alias("__seq"))
        .agg(F.max("__w.bare").alias("__bare"))
        .groupBy(*names)
        .agg(F.sum("__bare").alias("__total"))
    )
    alone = rows.filter(F.col("__w.basis_points").isNotNull()).withColumn(out, F.col("__w.basis_points").cast("bigint"))
    same = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(lot)]
    shared = (
        rows.filter(F.col("__w.bare").isNotNull())
        .join(total, same)
        .filter(F.col("__total") > 0)
        .withColumn(out, F.round(F.col("__w.bare") * 10_000 / F.col("__total")).cast("bigint"))
        .drop(*names, "__total")
    )
    return alone.unionByName(shared).drop("__w")
