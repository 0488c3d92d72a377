"""Which addresses robots.txt files allow an agent to request."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions import robots as rules
from lotwise.operators import web

#: The part of a robots.txt file that is read, in characters.
BODY = 512 * 1024
_RULES = "array<struct<pattern:string,allow:boolean>>"


def decide(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``urls`` with ``allowed`` and ``failed`` for an agent.

    ``robots`` (host, code, body, failed) has what each host answered; of repeated hosts the first body
    by text counts. A host without a row, or with an answer other than 200, has no rules; where the
    request failed nothing is known, so its addresses are not allowed and ``failed``. Each file is
    parsed once; the rules of the agent's group are joined by host. Null addresses are allowed: there
    is nothing to request.
    """

    @F.pandas_udf(_RULES)
    def own(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"pattern": p, "allow": ok} for p, ok in rules.group_of(rules.parse((b or "")[:BODY]), agent)])

    @F.pandas_udf("boolean")
    def permits(paths: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([rules.decide([(r["pattern"], r["allow"]) for r in rs], p) if rs is not None and p is not None else True for p, rs in zip(paths, found, strict=True)], dtype=bool)

    published = F.when((F.col("code") == 200) & ~F.coalesce("failed", F.lit(False)), F.col("body"))
    once = robots.filter(F.col("host").isNotNull()).groupBy(F.lower("host").alias("__host")).agg(F.min(published).alias("__body"), F.max(F.coalesce("failed", F.lit(False))).alias("__failed"))
    ready = once.withColumn("__rules", own(F.coalesce("__body", F.lit("")))).drop("__body")
    kept = [c for c in urls.columns if c not in ("allowed", "failed")]
    joined = urls.select(*kept).withColumn("__host", web.host(F.col(url))).join(ready, "__host", "left")
    told = joined.withColumn("failed", F.coalesce("__failed", F.lit(False))).withColumn("allowed", permits(web.request_path(F.col(url)), F.col("__rules")) & ~F.col("failed"))
    return told.select(*kept, "allowed", "failed")
