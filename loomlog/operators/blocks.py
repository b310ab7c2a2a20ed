"""Windows over keys that may be few and hot, in blocks, and folds that hold a bounded state.

A window over a key is one task a key. Here the order is cut into blocks (of time, of clocks), each of which is a window
of its own, and one row a block carries over what the next block needs. Keys and order must not be null; rows that fall
into one block of one key stay in one task.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lagged(rows: DataFrame, key: tuple, order: tuple, block: Column, take: dict[str, str]) -> DataFrame:
    """rows with the columns `take` ({new name: column}) of the row before, within the key and over the edges of blocks."""
    inside = Window.partitionBy(*key, "__block").orderBy(*order)
    held = F.struct(*[F.col(c).alias(name) for name, c in take.items()])
    cut = rows.withColumn("__block", block)
    last = cut.groupBy(*key, "__block").agg(F.max_by(held, F.struct(*order)).alias("__last"))
    carried = last.select(*key, "__block", F.lag("__last").over(Window.partitionBy(*key).orderBy("__block")).alias("__carried"))
    found = cut.withColumn("__before", F.lag(held).over(inside)).join(carried, [*key, "__block"])
    before = F.coalesce("__before", "__carried")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[before.getField(name).alias(name) for name in take])


def running(rows: DataFrame, key: tuple, order: tuple, block: Column, amount: Column, name: str) -> DataFrame:
    """rows with the sum of `amount` over the rows of the key up to each."""
    inside = Window.partitionBy(*key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumns({"__block": block, "__amount": amount})
    sums = cut.groupBy(*key, "__block").agg(F.sum("__amount").alias("__sum"))
    earlier = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    found = cut.withColumn("__inside", F.sum("__amount").over(inside)).join(offsets, [*key, "__block"])
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__inside") + F.col("__offset")).alias(name))


def numbered(rows: DataFrame, key: tuple, order: tuple, block: Column, name: str = "n") -> DataFrame:
    """rows with their number within the key, from 1."""
    return running(rows, key, order, block, F.lit(1).cast("long"), name)


def fold(rows: DataFrame, key: tuple, order: tuple, schema: str, start, step: Callable) -> DataFrame:
    """What `step(state, row)` makes of each key's rows in order: it returns the next state and a row of the schema, or None for no row.

    For rules that are sequential by nature. Rows are dealt and sorted by key and streamed, so a task holds one state and one
    batch, however long a key's history is.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, start
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                now = tuple(getattr(r, c) for c in key)
                if now != at:
                    at, state = now, start
                state, made = step(state, r)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(work, schema)
