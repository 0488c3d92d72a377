"""Arrow-batched string functions that parse each distinct value once a batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SEP = "\x1f"


def struct_udf(parse: Callable[[str], tuple], schema: StructType):
    """A pandas UDF over one string column, ``parse(value) -> tuple`` of the schema's fields.

    Values repeat a lot in such columns, so a batch is factorised and ``parse`` runs once for
    each distinct value. A null gives a struct of nulls.
    """
    names = schema.fieldNames()
    empty = tuple([None] * len(names))

    @F.pandas_udf(schema)
    def run(values: pd.Series) -> pd.DataFrame:
        codes, uniques = pd.factorize(values)
        rows = [parse(u) for u in uniques]
        rows.append(empty)  # code -1 takes the last
        return pd.DataFrame([rows[c] for c in codes], columns=names, dtype=object)

    return run
