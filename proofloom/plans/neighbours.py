"""Exact nearest candidates within a block, without forming all pairs of a block.

Candidates are cut into tiles: the cell of the nearest of a few pivot vectors, a ring of distance
to that pivot, and a hash split so that a tile stays small however large its block is.  A target
visits only tiles that the triangle inequality cannot rule out, each visit yields at most k rows,
and the k best of those are kept.  A cost that is no metric uses hash splits alone.  A cost with a
``tile`` finds the nearest of a tile itself, without the cost of every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE_ROWS = 2048
TARGET_TILE_ROWS = 512
TILE_NUMBERS = 1_000_000
RINGS = 8
#: Visited cells whose targets are written at once.
CELLS_AT_ONCE = 16
PARTS_PER_CORE = 4
#: What names a candidate tile.
PLACE = ["block", "pivot", "ring", "split"]
SLACK = 1e-9

_TARGET = "struct<target:bigint,vec:array<float>,limit_cost:double,limit_id:bigint>"
_CANDIDATE = "struct<candidate:bigint,vec:array<float>>"


def _tile_rows(limit: int, cost) -> int:
    """Rows of a tile, fewer the longer the vectors are."""
    return max(1, min(limit, TILE_NUMBERS // getattr(cost, "width", 1)))


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(vector, dtype=np.float64) for vector in vectors])


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as rows of numbers, without an object for each."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time; what a list holds stays in Arrow."""
    for batch in batches:
        for index in range(batch.num_rows):
            yield {name: getattr(held := column[index], "values", held) for name, column in zip(batch.schema.names, batch.columns)}


def _lists(parts: list[pa.Array]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(part) for part in parts]), pa.int32()), pa.concat_arrays(parts))


def _pivot_vectors(candidates: DataFrame, count: int) -> np.ndarray | None:
    """A handful of vectors in hash order; at most ``count`` rows reach the driver."""
    rows = candidates.select("candidate", "vec").orderBy(F.xxhash64("candidate"), "candidate").limit(count).collect()
    return _stack([row["vec"] for row in rows]) if rows else None


def _split(identifier: str, parts) -> F.Column:
    return F.pmod(F.xxhash64(F.col(identifier)), parts).cast("int")


def _candidate_cells(candidates: DataFrame, cost, pivots: np.ndarray | None) -> DataFrame:
    if pivots is None:
        return candidates.select(
            "block", "candidate", "vec", F.lit(0).alias("pivot"), F.lit(0).alias("ring"), F.lit(0.0).alias("dist")
        )
    spread = float(cost.matrix(pivots, pivots).max()) or 1.0

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TILE_ROWS) for b in batches for i in range(0, b.num_rows, TILE_ROWS)):
            away = cost.matrix(_matrix(batch.column(2)), pivots)
            nearest = away.argmin(axis=1)
            dist = away[np.arange(len(nearest)), nearest]
            ring = np.minimum(np.floor(dist / spread * RINGS), 4 * RINGS)
            found = [pa.array(nearest, pa.int32()), pa.array(ring.astype("int32"), pa.int32()), pa.array(dist, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=["block", "candidate", "vec", "pivot", "ring", "dist"])

    return candidates.select("block", "candidate", "vec").mapInArrow(
        locate, "block bigint, candidate bigint, vec array<float>, pivot int, ring int, dist double"
    )


def _visits(targets: DataFrame, tiles: DataFrame, cost, pivots: np.ndarray | None, k: int) -> DataFrame:
    """Target tiles split by the candidate tiles they must visit."""
    per_block = tiles.groupBy("block").agg(F.collect_list(F.struct("pivot", "ring", "n", "low", "high", "splits")).alias("cells"))
    sizes = targets.groupBy("block").agg(F.ceil(F.count("*") / _tile_rows(TARGET_TILE_ROWS, cost)).alias("_parts"))
    member = F.struct("target", "vec", "limit_cost", "limit_id").alias("member")
    grouped = (
        targets.join(sizes, "block")
        .withColumn("_part", _split("target", F.col("_parts")))
        .groupBy("block", "_part")
        .agg(F.collect_list(member).alias("members"))
        .join(per_block, "block")
        .select("block", "members", "cells")
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            members, cells = row["members"], row["cells"]
            keep = np.ones((len(members), len(cells)), dtype=bool)
            if pivots is not None:
                pivot, low, high, held = (_numbers(cells.field(name)) for name in ("pivot", "low", "high", "n"))
                away = cost.matrix(_matrix(members.field("vec")), pivots)[:, pivot]
                nearest_possible = np.maximum(np.maximum(away - high, low - away), 0)
                farthest_possible = away + high
                order = np.argsort(farthest_possible, axis=1)
                reached = np.cumsum(held[order], axis=1) >= k
                first = np.where(reached.any(axis=1), reached.argmax(axis=1), len(cells) - 1)
                bound = np.take_along_axis(farthest_possible, order, axis=1)[np.arange(len(members)), first]
                bound = np.where(reached.any(axis=1), bound, np.inf)
                limits = _numbers(members.field("limit_cost")).astype(float)
                bound = np.where(np.isnan(limits), bound, limits)
                keep = nearest_possible <= bound[:, None] + SLACK
            visited = np.flatnonzero(keep.any(axis=0))
            # A target is written once per cell it visits: a few cells at a time, however many there are.
            for start in range(0, len(visited), CELLS_AT_ONCE):
                some = visited[start : start + CELLS_AT_ONCE]
                places = [cells.field(name).take(pa.array(some)) for name in ("pivot", "ring", "splits")]
                chosen = _lists([members.take(pa.array(np.flatnonzero(keep[:, index]))) for index in some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"].as_py()] * len(some), pa.int64()), *places, chosen], names=["block", "pivot", "ring", "splits", "members"]
                )

    visits = grouped.mapInArrow(choose, f"block bigint, pivot int, ring int, splits int, members array<{_TARGET}>")
    return visits.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")


def _tile_pairs(targets: DataFrame, candidates: DataFrame, cost, k: int, pivot_count: int) -> DataFrame:
    """One record per (target tile, candidate tile) to compare."""
    pivots = _pivot_vectors(candidates, pivot_count) if cost.metric and pivot_count else None
    cells = _candidate_cells(candidates, cost, pivots)
    tiles = cells.groupBy("block", "pivot", "ring").agg(
        F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"),
        F.ceil(F.count("*") / _tile_rows(TILE_ROWS, cost)).cast("int").alias("splits"),
    )
    packed = (
        cells.join(tiles.select("block", "pivot", "ring", "splits"), ["block", "pivot", "ring"])
        .withColumn("split", _split("candidate", F.col("splits")))
        .groupBy("block", "pivot", "ring", "split")
        .agg(F.collect_list(F.struct("candidate", "vec")).alias("held"))
    )
    # A fixed number of parts: tiles are few bytes and much work, and would be put together by their bytes.
    parts = PARTS_PER_CORE * targets.sparkSession.sparkContext.defaultParallelism
    # Without pivots, cell and ring are constants, which a join drops from its keys: parts by them would be dealt anew.
    dealt = PLACE if pivots is not None else ["block", "split"]
    return _visits(targets, tiles, cost, pivots, k).repartition(parts, *dealt).join(packed.hint("shuffle_merge"), PLACE)


def _standard(df: DataFrame, block: str, identifier: str, vector: str, name: str) -> DataFrame:
    return df.select(
        F.col(block).cast("bigint").alias("block"), F.col(identifier).cast("bigint").alias(name), F.col(vector).cast("array<float>").alias("vec")
    )


def _tie_break(targets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """A number of its own for every pair, by which a target orders candidates of equal cost."""
    one, other = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    mixed = (targets.astype(np.uint64)[:, None] * one) ^ ((candidates.astype(np.uint64)[None, :] + np.uint64(1)) * other)
    return (((mixed ^ (mixed >> np.uint64(31))) * one) >> np.uint64(1)).astype(np.int64)


def nearest(
    targets: DataFrame, candidates: DataFrame, cost, k: int, *, block: str, target: str, candidate: str, vector: str, pivots: int = 16,
    spread_ties: bool = False,
) -> DataFrame:
    """The k candidates of least (cost, id) for every target: block, target, candidate, cost, rank.

    With ``spread_ties`` every target has an order of its own among candidates of equal cost.
    """
    left = (
        _standard(targets, block, target, vector, "target")
        .withColumn("limit_cost", F.lit(None).cast("double")).withColumn("limit_id", F.lit(None).cast("bigint"))
    )
    right = _standard(candidates, block, candidate, vector, "candidate")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for row in _rows(batches):
            members, held = row["members"], row["held"]
            here = [row[name].as_py() for name in PLACE]
            if here != known:  # all that visit a tile follow each other
                ids = _numbers(held.field("candidate"))
                order = np.argsort(ids)
                ids, vectors, known = ids[order], _matrix(held.field("vec"))[order], here
                # Of equal candidates the k first by id are enough, unless every target has an order of its own.
                tile = cost.tile(vectors, None if spread_ties else k) if hasattr(cost, "tile") else None
            wanted, asking = _matrix(members.field("vec")), _numbers(members.field("target"))
            # What may be among the k best, row by row and by id.
            enough = min(k, len(ids))
            if tile is not None:
                rows, columns, found = tile.nearest(wanted, enough)
            else:
                costs = cost.matrix(wanted, vectors)
                rows, columns = np.nonzero(~(costs > np.partition(costs, enough - 1, axis=1)[:, enough - 1, None]))
                found = costs[rows, columns]
            ties = _tie_break(asking, ids)[rows, columns] if spread_ties else np.zeros(len(rows), dtype=np.int64)
            best = np.lexsort((ties, found, rows))
            starts = np.searchsorted(rows, np.arange(len(asking)))
            best = best[np.arange(len(rows)) - starts[rows] < enough]
            yield pa.RecordBatch.from_arrays([
                pa.array([row["block"].as_py()] * len(best), pa.int64()), pa.array(asking[rows[best]], pa.int64()), pa.array(ids[columns[best]], pa.int64()),
                pa.array(found[best], pa.float64()), pa.array(ties[best], pa.int64()),
            ], names=["block", "target", "candidate", "cost", "tie"])

    found = _tile_pairs(left, right, cost, k, pivots).mapInArrow(
        compare, "block bigint, target bigint, candidate bigint, cost double, tie bigint"
    )
    order = Window.partitionBy("block", "target").orderBy("cost", "tie", "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("tie")


def rank_of(
    named: DataFrame, candidates: DataFrame, cost, *, block: str, target: str, candidate: str, vector: str, named_cost: str,
    named_id: str, pivots: int = 16,
) -> DataFrame:
    """Rank of one named candidate per target among all its block: block, target, rank.

    Only a count leaves each tile, so the full ranking of a catalogue is never written out.
    """
    left = named.select(
        F.col(block).cast("bigint").alias("block"), F.col(target).cast("bigint").alias("target"),
        F.col(vector).cast("array<float>").alias("vec"), F.col(named_cost).alias("limit_cost"), F.col(named_id).cast("bigint").alias("limit_id"),
    )
    right = _standard(candidates, block, candidate, vector, "candidate")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            members, held = row["members"], row["held"]
            ids = _numbers(held.field("candidate"))
            costs = cost.matrix(_matrix(members.field("vec")), _matrix(held.field("vec")))
            limit = _numbers(members.field("limit_cost"))[:, None]
            tied = np.abs(costs - limit) <= SLACK
            ahead = ((costs < limit) & ~tied) | (tied & (ids[None, :] < _numbers(members.field("limit_id"))[:, None]))
            yield pa.RecordBatch.from_arrays([
                pa.array([row["block"].as_py()] * len(members), pa.int64()), members.field("target"), pa.array(ahead.sum(axis=1), pa.int64()),
            ], names=["block", "target", "ahead"])

    counted = _tile_pairs(left, right, cost, 1, pivots).mapInArrow(count, "block bigint, target bigint, ahead bigint")
    ahead = counted.groupBy("block", "target").agg(F.sum("ahead").alias("ahead"))
    return (
        left.select("block", "target").join(ahead, ["block", "target"], "left")
        .select("block", "target", (F.coalesce("ahead", F.lit(0)) + 1).alias("rank"))
    )
