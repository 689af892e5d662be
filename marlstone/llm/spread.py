"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of more than a HEAVY-th of all rows (and of LEAST rows) are dealt into parts; there are HEAVY of them at most.
HEAVY = 10_000
LEAST = 400


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, salt: Column) -> DataFrame:
    """Inner join of rows with a table that has each key once and the number of its rows in a column `count`.

    A heavy key's rows are dealt by `salt` (a hash that tells them apart) into parts of about the limit, and the
    key's table row goes to each part. Heavy keys reach the tasks by broadcast: by the limit there are HEAVY at most,
    whatever the size of the input, and they make at most as many parts. The table is read twice, so give a written
    one. `count` is left out of the result; keys that are null join nothing.
    """
    total = table.agg(F.sum(count).alias("n")).first().n or 0
    parts = F.ceil(F.col(count) / max(LEAST, total // HEAVY)).cast("int")
    heavy = table.where(parts > 1).select(*keys, parts.alias("spread_parts"))
    dealt = rows.join(F.broadcast(heavy), keys, "left")
    dealt = dealt.withColumn("spread_salt", F.coalesce(F.pmod(salt, F.col("spread_parts")), F.lit(0)).cast("int")).drop("spread_parts")
    repeated = table.withColumn("spread_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return dealt.join(repeated, [*keys, "spread_salt"]).drop("spread_salt")
