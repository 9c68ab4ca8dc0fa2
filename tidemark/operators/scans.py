"""Running values along each address that no hot address can gather in one task.

A window over an address sorts all its rows in one task. Here an address is cut into blocks of sequences: rows run within
their block, one row per block carries its total on, and both are put together. Blocks hold at most BLOCK sequences, so
neither a task's group nor the carry of an address (rows / BLOCK) grows with the hottest address alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequences of a block.
BLOCK = 1 << 20

#: Bytes, by the planner's estimate, that a task of `spread` gets; an estimate behind joins may be far too high, so no more tasks than these.
SPREAD, MOST_TASKS = 4 << 20, 2000

KINDS = ("last", "sum", "count", "min", "max")


def blocked(df: DataFrame, seq: str = "seq", width: int | None = None) -> DataFrame:
    """df with _block, the block of each row."""
    return df.withColumn("_block", F.floor(F.col(seq) / F.lit(width or BLOCK)))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns over so many tasks that each holds about SPREAD bytes, however large df is. A number that is
    stated is kept: a plan that adapts puts up to 64 MB of packed rows into one task, which unpacked are a GB to sort."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, min(-(-size // SPREAD), MOST_TASKS)), *columns)


def running(df: DataFrame, address: Sequence[str], columns: dict[str, tuple[str, Column]], order: Sequence[Column | str] = ("seq",), inclusive: bool = False) -> DataFrame:
    """df (with _block) and, for each name, the `last` non-null, `sum`, `count`, `min` or `max` of an expression over the
    rows of the address before this one (inclusive: up to it). Sums and counts of nothing are 0, the others null."""
    made = {name: (kind, f"_in_{name}") for name, (kind, _) in columns.items()}
    rows = df.withColumns({f"_in_{name}": expr for name, (_, expr) in columns.items()})
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]) if len(order) > 1 else (F.col(order[0]) if isinstance(order[0], str) else order[0])

    def whole(kind: str, c: str) -> Column:
        if kind == "last":
            return F.max_by(c, F.when(F.col(c).isNotNull(), place))
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](c)

    def over(kind: str, c: str, w) -> Column:
        if kind == "last":
            return F.last(c, ignorenulls=True).over(w)
        # counts of blocks add up
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](c).over(w)

    totals = rows.groupBy(*address, "_block").agg(*[whole(kind, c).alias(f"_t_{name}") for name, (kind, c) in made.items()])
    before = Window.partitionBy(*address).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*address, "_block", *[over("sum" if kind == "count" else kind, f"_t_{name}", before).alias(f"_c_{name}") for name, (kind, _) in made.items()])
    inside = Window.partitionBy(*address, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumns({f"_r_{name}": over(kind, c, inside) for name, (kind, c) in made.items()})
    rows = rows.join(carried, [*address, "_block"])

    def both(name: str, kind: str) -> Column:
        r, c = F.col(f"_r_{name}"), F.col(f"_c_{name}")
        if kind == "last":
            return F.coalesce(r, c)
        if kind in ("sum", "count"):
            return F.coalesce(r, F.lit(0)) + F.coalesce(c, F.lit(0))
        return F.least(r, c) if kind == "min" else F.greatest(r, c)

    out = rows.withColumns({name: both(name, kind) for name, (kind, _) in made.items()})
    return out.drop(*[f"_{p}_{name}" for p in ("in", "r", "c") for name in made])
