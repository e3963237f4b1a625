"""Row-relative columns over an order, without one task per key.

A window over a whole key fails for a key that holds much of the table. These
columns are computed in two levels: within (key, chunk of the order), and over one
summary row per chunk. The chunk is a stretch of the first order column, so its size
does not grow with the key's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One hour of recording, in milliseconds.
HOUR = 3_600_000


def with_order(df: DataFrame, key: str, order: list[str], width: int = HOUR, lag: dict[str, str] | None = None, total: dict[str, str] | None = None, reach: dict[str, str] | None = None) -> DataFrame:
    """`df` with columns that look at earlier rows of the same key.

    lag: {new: column} the value of the row before (null at the start).
    total: {new: column} the sum up to and with this row.
    reach: {new: column} the greatest value of all rows before (null at the start).
    order[0] is a number that is cut into chunks of `width`; rows that tie in all of
    `order` come in any order. Null order values come first.
    """
    lag, total, reach = lag or {}, total or {}, reach or {}
    chunk = F.floor(F.col(order[0]) / F.lit(width)).alias("_chunk")
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = df.select("*", chunk).select(
        "*",
        F.row_number().over(w).alias("_n"),
        *(F.lag(c).over(w).alias(f"_lag_{n}") for n, c in lag.items()),
        *(F.sum(c).over(so_far).alias(f"_sum_{n}") for n, c in total.items()),
        *(F.max(c).over(past).alias(f"_max_{n}") for n, c in reach.items()),
    )
    chunks = inner.groupBy(key, "_chunk").agg(
        F.max_by(F.struct(F.lit(1).alias("_one"), *(F.col(c).alias(n) for n, c in lag.items())), "_n").alias("_tail"),
        *(F.sum(c).alias(f"_all_{n}") for n, c in total.items()),
        *(F.max(c).alias(f"_top_{n}") for n, c in reach.items()),
    )
    over = Window.partitionBy(key).orderBy("_chunk")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        F.col(key).alias("_k"),
        F.col("_chunk").alias("_c"),
        F.lag("_tail").over(over).alias("_prev"),
        *(F.sum(f"_all_{n}").over(before).alias(f"_from_{n}") for n in total),
        *(F.max(f"_top_{n}").over(before).alias(f"_had_{n}") for n in reach),
    )
    out = inner.join(carried, (F.col(key) == F.col("_k")) & F.col("_chunk").eqNullSafe(F.col("_c")), "left")
    new: dict[str, Column] = {n: F.when(F.col("_n") == 1, F.col(f"_prev.{n}")).otherwise(F.col(f"_lag_{n}")) for n in lag}
    new |= {n: F.coalesce(f"_from_{n}", F.lit(0)) + F.col(f"_sum_{n}") for n in total}
    new |= {n: F.greatest(f"_had_{n}", f"_max_{n}") for n in reach}
    return out.select(*df.columns, *(c.alias(n) for n, c in new.items()))
