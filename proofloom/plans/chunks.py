"""Ordered scans over keys that may hold a large share of all rows.

A window partitioned by such a key sorts and walks all its rows in one task.  Here every key is
cut into chunks by a column that never decreases along the order (a day, or position div n).
The window runs per (key, chunk); one summary row per chunk carries the state across chunks, and
only those summaries meet in a window per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_chunk(position: Column, size: int = 100_000) -> Column:
    """Chunk number of an integer position."""
    return F.floor(position / F.lit(size))


def _with_chunk(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn("_chunk", chunk)


def _rows_up_to_here(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _earlier_chunks(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _join_back(rows: DataFrame, summary: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join one summary row per (key, chunk) to the rows; null keys and null chunks meet their own."""
    names = [*keys, "_chunk"]
    renamed = summary.select(*[F.col(name).alias(f"_own_{i}") for i, name in enumerate(names)], *[c for c in summary.columns if c not in names])
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & rows[name].eqNullSafe(renamed[f"_own_{i}"])
    return rows.join(renamed, same, how).drop(*[f"_own_{i}" for i in range(len(names))])


def running_sum(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the key's rows up to and including this one."""
    rows = _with_chunk(df, chunk).withColumn("_value", value)
    before = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(_earlier_chunks(keys)), F.lit(0)))
        .drop("_total")
    )
    local = rows.withColumn("_local", F.sum("_value").over(_rows_up_to_here(keys, order)))
    return (
        _join_back(local, before, keys)
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_chunk", "_value", "_local", "_before")
    )


def number_rows(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], out: str) -> DataFrame:
    """Exact row number from 1 within the key; ``order`` must be unique within it."""
    return running_sum(df, keys, chunk, order, F.lit(1).cast("bigint"), out)


def carry_forward(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row of the key."""
    rows = _with_chunk(df, chunk)
    tails = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, "_chunk")
        .agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    )
    chunks = _join_back(rows.select(*keys, "_chunk").distinct(), tails, keys, "left")
    before = chunks.withColumn("_before", F.last("_tail", ignorenulls=True).over(_earlier_chunks(keys))).drop("_tail")
    local = F.last(value, ignorenulls=True).over(_rows_up_to_here(keys, order))
    return (
        _join_back(rows.withColumn("_local", local), before, keys)
        .withColumn(out, F.coalesce("_local", "_before"))
        .drop("_chunk", "_local", "_before")
    )


def following(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """``value`` (never null) of the key's next row; null on its last row."""
    rows = _with_chunk(df, chunk)
    heads = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.min_by(value, F.struct(*order)).alias("_head"))
        .withColumn("_after", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_chunk")))
        .drop("_head")
    )
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        _join_back(rows.withColumn("_local", F.lead(value).over(in_chunk)), heads, keys)
        .withColumn(out, F.coalesce("_local", "_after"))
        .drop("_chunk", "_local", "_after")
    )


def trailing_aggregates(
    df: DataFrame, keys: list[str], epoch: str, width: int, aggregates: dict[str, Column]
) -> DataFrame:
    """Aggregates over the key's rows with epoch in (row epoch - width, row epoch].

    Every row is sent to its own bucket of ``width`` seconds and to the next one, so each bucket
    is complete for its own rows and no task sees more than two buckets of one key.
    """
    own = F.floor(F.col(epoch) / F.lit(width))
    buckets = F.when(own.isNull(), F.array(own)).otherwise(F.array(own, own + 1))  # rows without an epoch keep to themselves
    spread = df.withColumn("_bucket", F.explode(buckets))
    window = Window.partitionBy(*keys, "_bucket").orderBy(epoch).rangeBetween(-(width - 1), 0)
    kept = spread
    for name, aggregate in aggregates.items():
        kept = kept.withColumn(name, aggregate.over(window))
    return kept.where(F.col("_bucket").eqNullSafe(own)).drop("_bucket")


def trailing_sums(
    df: DataFrame, keys: list[str], epoch: str, width: int, chunk: int, sums: dict[str, Column], onto: DataFrame | None = None
) -> DataFrame:
    """Whole-number sums over the key's rows with epoch in (row epoch - width, row epoch]; rows without an epoch see each other.

    A value counts from its epoch on and is taken back ``width`` later, so one running sum per key over both kinds
    of change gives every window: rows of one instant are added up first, the changes are cut into chunks of
    ``chunk`` seconds, and the work grows with the rows, however many of them a window holds.  A null counts as 0.
    ``onto`` is what gets the sums instead of ``df``: its rows with more columns, so that those are not made for the sums.
    """
    undated = [*keys, "_undated"]
    rows = df.withColumn("_undated", F.col(epoch).isNull())
    gained = rows.select(*undated, F.col(epoch).alias("_at"), *[F.coalesce(value, F.lit(0)).cast("bigint").alias(f"_gain_{name}") for name, value in sums.items()])
    gains = [f"_gain_{name}" for name in sums]
    at_once = gained.groupBy(*undated, "_at").agg(*[F.sum(g).alias(g) for g in gains], F.lit(True).alias("_seen"))
    lost = at_once.where("NOT _undated").select(*undated, (F.col("_at") + width).alias("_at"), *[(-F.col(g)).alias(g) for g in gains], F.lit(False).alias("_seen"))
    changes = at_once.unionByName(lost).groupBy(*undated, "_at").agg(*[F.sum(g).alias(g) for g in gains], F.max("_seen").alias("_seen"))
    # Whole changes travel through one scan: the chunk's own part by a window, earlier chunks by their totals.
    held = _with_chunk(changes, F.floor(F.col("_at") / F.lit(chunk)))
    totals = held.groupBy(*undated, "_chunk").agg(*[F.sum(g).alias(g) for g in gains])
    before = totals.select(*undated, "_chunk", *[F.coalesce(F.sum(g).over(_earlier_chunks(undated)), F.lit(0)).alias(f"_before{g}") for g in gains])
    local = held.select("*", *[F.sum(g).over(_rows_up_to_here(undated, [F.col("_at")])).alias(f"_local{g}") for g in gains]).where("_seen")
    usage = _join_back(local, before, undated).select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(undated)], "_at", *[(F.col(f"_before_gain_{name}") + F.col(f"_local_gain_{name}")).alias(name) for name in sums]
    )
    same = F.col(epoch).eqNullSafe(F.col("_at"))
    for i, key in enumerate(undated):
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{i}"))
    given = rows if onto is None else onto.withColumn("_undated", F.col(epoch).isNull())
    return given.join(usage, same).drop("_at", "_undated", *[f"_key_{i}" for i in range(len(undated))])
